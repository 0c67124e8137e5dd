"""Operators for large-scale training data, and their queries (``llm.queries``)."""
