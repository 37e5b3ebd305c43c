"""Relational operators: filters, joins, aggregates, sequences, retrieval, mutations, graphs."""
