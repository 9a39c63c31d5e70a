"""splitboard: competition-results analytics on PySpark DataFrames."""
