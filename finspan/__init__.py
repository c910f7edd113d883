"""finspan: market, portfolio and text-corpus analytics on Spark DataFrames."""
