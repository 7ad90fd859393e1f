"""Spark operators for preparing, synthesising and judging series, corpora and sensor logs."""
