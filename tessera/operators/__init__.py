"""Relational operators: search, fusion, gating, joins, audits, metrics."""
