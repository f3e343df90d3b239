"""Decision-value analytics on Spark: positional data, event logs, market tables."""
