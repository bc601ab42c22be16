"""Registered queries with the SQL that says the same."""
