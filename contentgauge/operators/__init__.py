"""operators of the content-quality engine."""
