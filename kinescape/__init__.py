"""Spark-native analytics of time-lapse image measurements and trajectories."""
