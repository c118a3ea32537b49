"""Trip-telemetry feature and risk-scoring operators on Spark DataFrames."""

import sys as _sys

try:
    # Ship this package's functions (pandas UDFs, applyInPandas steps) to the Python workers by
    # value, so executors need no installed copy of the package.
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: workers then import the package
    pass
