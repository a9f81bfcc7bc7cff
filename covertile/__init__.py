"""Interval coverage, segment calling and training-data operators on PySpark."""
