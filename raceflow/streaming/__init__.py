"""Incremental (resume and upsert) helpers usable from ``foreachBatch``."""
