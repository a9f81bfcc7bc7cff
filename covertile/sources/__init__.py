"""Readers that give the library's tables, and writers of its results."""
