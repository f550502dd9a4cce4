"""sources of the content-quality engine."""
