"""Readers and writers of raw lists, feeds, job messages and the engine's tables."""
