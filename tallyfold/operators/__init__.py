"""Relational building blocks the plans share: joins, keyed picks, merges, paging."""
