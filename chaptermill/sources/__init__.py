"""Readers of text assets, manifests and constructed books."""
