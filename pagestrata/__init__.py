"""Web-archive analytics and corpus preparation on Spark."""
