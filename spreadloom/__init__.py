"""Spark-first relative-value analytics over time-stamped prices."""
