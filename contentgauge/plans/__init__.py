"""plans of the content-quality engine."""
