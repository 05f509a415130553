"""Conflict-graph analytics on Spark: interval conflicts, selections, recovery, replay and strict statistics."""
