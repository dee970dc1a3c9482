"""Joins, aggregates, windows and reports over grouped event tables."""
