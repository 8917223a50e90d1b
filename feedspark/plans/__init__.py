"""Plans of the feed-analytics engine."""
