"""Distributed building blocks: row order, kept tables, skew-safe joins, counts, quantiles, rules."""
