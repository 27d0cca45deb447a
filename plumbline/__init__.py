"""Analytics over measured drawings, expressed as Spark DataFrames."""
