"""Registered queries: each module pairs library calls on the given tables with the same query in SQL."""
