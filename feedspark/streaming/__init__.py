"""Streaming of the feed-analytics engine."""
