"""Audit and preparation of labelled text tables on Spark."""
