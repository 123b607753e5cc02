"""almanac: panel analytics and early-warning operators for Apache Spark.

Every operator is a function from DataFrames to a DataFrame (or from columns to a
column).  Nothing is executed until the caller runs an action, except where a
docstring says that a bounded set of cut points is fetched first.
"""
