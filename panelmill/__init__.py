"""Spark-first analytics for cross-sectional time-series panels.

Every operator takes and returns DataFrames and stays lazy.  Sub-packages:
``operators`` (the query operators), ``sources`` (scans and sinks), ``functions``
(column expressions), ``plans`` (named queries with their SQL twins) and
``streaming`` (Structured Streaming bars).
"""

__version__ = "0.1.0"
