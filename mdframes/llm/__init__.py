"""Operators for preparing training data: one module per operator, each a Spark job over whole tables."""
