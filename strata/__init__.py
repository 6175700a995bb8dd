"""Analytics over code-intelligence relations, as Spark DataFrames."""
