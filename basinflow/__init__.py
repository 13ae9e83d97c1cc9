"""basinflow: Spark-first relational, streaming and training-data operators."""
