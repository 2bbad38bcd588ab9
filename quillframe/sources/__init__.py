"""Readers and writers for assets, labels, manifests, histories and event logs."""
