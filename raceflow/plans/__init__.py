"""Compositions of operators: feature tables, evaluation, validation."""
