"""Operators for preparing training data from texts, conversations and embeddings."""
