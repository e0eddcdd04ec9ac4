"""Notice collection and analytics on Spark."""
