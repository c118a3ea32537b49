"""Training-data operators. Nothing outside this subpackage imports it; see :mod:`tripsense.llm.queries`."""
