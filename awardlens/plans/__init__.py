"""plans of the award analytics engine."""
