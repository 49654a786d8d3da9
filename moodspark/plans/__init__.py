"""Schemas, checkpoints, stage runs, reports and the query catalogue."""
