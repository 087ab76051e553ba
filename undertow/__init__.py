"""undertow: delta-accumulative iterative analytics on Spark DataFrames."""
