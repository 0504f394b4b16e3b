"""Package health and risk analytics on Spark.

Every operator takes and returns DataFrames (or Columns); "now" is always an
explicit argument.  See README.md for the layout.
"""
