"""Spark-first analytics for particle trajectories: frames are rows, frame sets are partitions."""
