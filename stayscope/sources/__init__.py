"""Readers, writers and the views that stand in for clinical tables."""
