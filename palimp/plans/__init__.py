"""Registered queries over the given tables, with their oracle SQL."""
