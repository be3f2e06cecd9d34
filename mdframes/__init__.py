"""Molecular-dynamics trajectory analytics as Spark DataFrame jobs."""
