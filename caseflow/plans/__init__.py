"""Composite plans (process analytics, ML) and the query registry."""
