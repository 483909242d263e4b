"""Sanitising and trends over streams."""
