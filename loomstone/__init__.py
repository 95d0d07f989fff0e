"""Function-corpus analytics on Spark."""
