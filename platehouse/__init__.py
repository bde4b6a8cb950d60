"""Analytics over vehicle and licence-plate observations, built on Spark DataFrames."""
