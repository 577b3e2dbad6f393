"""Document analytics on Spark DataFrames: many documents at once, every operator a query plan."""
