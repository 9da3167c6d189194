"""Composed plans: the seasonal run, and the registered queries with their SQL."""
