"""gridair: gridded and station air-quality analytics as Spark DataFrame operators.

Every public operator is a plain function that takes DataFrames (and columns) and returns a DataFrame or a
Column.  Nothing here owns a session, collects a table or keeps state outside Spark.
"""

__version__ = "0.1.0"
