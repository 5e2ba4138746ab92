"""Registered queries: each a small plan over the given tables, with the same question in SQL."""
