"""Readers that turn landed exports into the normalised record shape."""
