"""Context-aware retrieval analytics on Spark."""
