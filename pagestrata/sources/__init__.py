"""Web-archive analytics: sources."""
