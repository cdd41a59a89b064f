"""Readers: canonical tables, test-table bindings, JDBC, nested JSON documents, text."""
