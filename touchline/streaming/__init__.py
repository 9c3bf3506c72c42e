"""Structured Streaming: event windows, last snapshots, ratings."""
