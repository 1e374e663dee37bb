"""Product-search read models on Spark: build, query, validate and keep them in sync."""
