"""Readers and writers of cubes and model tables."""
