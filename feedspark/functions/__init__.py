"""Functions of the feed-analytics engine."""
