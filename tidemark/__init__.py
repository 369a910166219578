"""Event-archive analytics on PySpark DataFrames."""
