"""Readers and writers of packed binary objects."""
