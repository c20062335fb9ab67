"""tablelearn: tabular machine-learning operators over Spark DataFrames.

Every operator takes a DataFrame (one row per sample, an ``id`` column and
named feature columns) and returns DataFrames: transformed rows, fitted
parameter tables, predictions or metric rows.  Heavy work runs as Spark
aggregates, joins and windows; only p x p algebra (p = number of features)
runs on the driver.
"""

__version__ = "0.1.0"
