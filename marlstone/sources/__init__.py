"""Readers and writers of attempt tables."""
