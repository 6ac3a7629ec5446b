"""Analytics over collections annotated by people and machines, on Spark DataFrames."""
