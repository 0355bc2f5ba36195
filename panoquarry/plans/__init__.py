"""plans of the panorama analytics engine."""
