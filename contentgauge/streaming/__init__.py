"""streaming of the content-quality engine."""
