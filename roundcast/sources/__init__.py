"""Readers, writers, the event codec and its data-quality rules."""
