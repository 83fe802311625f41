"""Web-archive analytics: streaming."""
