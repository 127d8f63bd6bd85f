"""Readers: files, archives, listings, and the projection of tables to a graph."""
