"""Operators beyond plain SQL: changing tables, approximate counts, plan reports."""
