"""Batch text retrieval, ranking evaluation and training-data processing on Spark."""
