"""functions of the panorama analytics engine."""
