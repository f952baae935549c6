"""Streaming operators over view and event streams, with batch forms of the same rules."""
