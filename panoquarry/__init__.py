"""Panorama detection analytics, expressed as Spark DataFrame plans."""
