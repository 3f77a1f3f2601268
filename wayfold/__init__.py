"""Batch analytics for indoor maps and pedestrian networks, built on PySpark DataFrames."""
