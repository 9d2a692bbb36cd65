"""Spatial annotation analytics and training-data preparation on Spark."""
