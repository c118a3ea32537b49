"""Column expressions (JVM side, codegen friendly) used by the operators."""

from tripsense.functions.columns import (
    log1p_shift,
    nan_to_null,
    norm3,
    select_prefix,
    with_norms,
)

__all__ = [
    "log1p_shift", "nan_to_null", "norm3", "select_prefix", "with_norms",
]
