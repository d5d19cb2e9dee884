"""Market time-series analytics as Spark jobs: every operator takes and returns DataFrames for all symbols at once."""
