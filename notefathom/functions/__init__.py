"""Column builders and Arrow-batched functions."""
