"""Grouped, skew-aware DataFrame operators: trip features, labels, sampling, evaluation, profiling."""
