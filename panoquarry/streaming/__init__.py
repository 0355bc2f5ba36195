"""streaming of the panorama analytics engine."""
