"""Readers and writers for the text formats around sequence data."""
