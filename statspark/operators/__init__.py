"""Metrics, resampling, correlation, drift, preprocessing and selection."""
