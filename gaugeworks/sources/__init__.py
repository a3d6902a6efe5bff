"""Readers, writers, and the mapping of foreign columns and layouts onto the model."""
