"""Registered queries, their fixture views and their SQL twins."""
