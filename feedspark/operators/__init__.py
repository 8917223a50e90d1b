"""Operators of the feed-analytics engine."""
