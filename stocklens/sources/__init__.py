"""Readers, writers and the snapshot cache."""
