"""Readers, checks and writers of gridded tables."""
