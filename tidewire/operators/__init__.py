"""Relational story analytics: aggregates, joins, windows, ranking."""
