"""Power samples, firmware events and budgets as Spark DataFrames."""
