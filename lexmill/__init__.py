"""lexmill: Spark-first text analytics, retrieval and corpus preparation."""
