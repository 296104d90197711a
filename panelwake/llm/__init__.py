"""Operators of a training-data pipeline over documents, benchmarks, conversations and embeddings."""
