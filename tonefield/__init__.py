"""Target-sentiment analytics on Spark."""
