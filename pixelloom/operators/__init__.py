"""Operators over pixel-time tables."""
