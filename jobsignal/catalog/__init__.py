"""Registered queries and their SQL by operator family; each module has QUERIES and SQL dictionaries."""
