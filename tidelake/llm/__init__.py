"""Operators on texts, and the matching of records by time. Nothing outside this subpackage imports it."""
