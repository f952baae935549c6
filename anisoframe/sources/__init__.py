"""Readers and writers of point files and manifests."""
