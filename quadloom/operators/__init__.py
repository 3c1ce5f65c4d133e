"""Relational operators over solution tables: scans, joins, set operations, aggregation, order."""
