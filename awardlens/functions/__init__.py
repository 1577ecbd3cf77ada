"""functions of the award analytics engine."""
