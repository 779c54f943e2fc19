"""Loaders and writers."""
