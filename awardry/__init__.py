"""Award analytics and corpus preparation on Spark."""
