"""sources of the panorama analytics engine."""
