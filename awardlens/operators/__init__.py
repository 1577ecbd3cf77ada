"""operators of the award analytics engine."""
