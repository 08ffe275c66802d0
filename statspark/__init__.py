"""Statistics and model evaluation as Spark DataFrame operators.

Functions take a DataFrame and column names, and return lazy DataFrames or
Columns. Metrics accept ``weight`` (a column of sample weights) and ``by`` (columns
of groups). An undefined ratio is NULL. Rows with a null or NaN in a column
that a metric reads are dropped.
"""
