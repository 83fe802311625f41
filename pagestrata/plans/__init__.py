"""Web-archive analytics: plans."""
