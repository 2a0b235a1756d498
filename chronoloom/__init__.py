"""Spark-native analytics for temporal knowledge graphs and agent memory.

Every operator is a function from DataFrames to a DataFrame.  Plans are declared with built-in
expressions wherever they can say it; Python runs in Arrow batches only for sequential kernels.
"""

__version__ = "0.1.0"
