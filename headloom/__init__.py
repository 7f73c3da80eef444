"""HTTP response analytics on Spark."""
