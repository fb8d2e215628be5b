"""Trajectory-evaluation analytics on Spark."""
