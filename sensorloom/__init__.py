"""Analytics of high-rate sensor runs on Spark."""
