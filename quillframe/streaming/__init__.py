"""Streams over event logs."""
