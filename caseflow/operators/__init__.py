"""Relational, aggregate, window, statistics, graph and text-corpus operators."""
