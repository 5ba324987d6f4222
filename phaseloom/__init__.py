"""Trajectory, evaluation, retrieval and evidence analytics as Spark plans."""
