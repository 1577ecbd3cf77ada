"""sources of the award analytics engine."""
