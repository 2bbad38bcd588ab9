"""Operators: DataFrames in, DataFrames out. scene_id keeps small quadratic work inside a scene."""
