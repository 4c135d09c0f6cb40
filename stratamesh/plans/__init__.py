"""Registered queries with the SQL that states them, and helpers that cut plans."""
