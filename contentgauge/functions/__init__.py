"""functions of the content-quality engine."""
