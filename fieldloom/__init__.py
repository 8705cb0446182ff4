"""Pixel series, field labels and class maps as Spark jobs."""
