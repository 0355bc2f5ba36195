"""operators of the panorama analytics engine."""
