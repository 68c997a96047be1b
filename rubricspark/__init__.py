"""Policy scoring, retrieval and reporting as Spark DataFrame jobs."""
