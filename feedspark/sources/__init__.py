"""Sources of the feed-analytics engine."""
