"""Spark-first text cleaning, similarity and clustering of structured records."""
