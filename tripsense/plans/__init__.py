"""Whole plans: the feature transform, model training/scoring, the batch job and the SQL oracle."""
