"""Metrics over streams."""
