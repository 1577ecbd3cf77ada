"""streaming of the award analytics engine."""
