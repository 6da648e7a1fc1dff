"""Whole jobs: population, stability, discrimination and published tables."""
