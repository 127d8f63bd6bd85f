"""Operators over graph and usage tables."""
