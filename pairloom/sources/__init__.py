"""Readers and writers of the curation tables."""
