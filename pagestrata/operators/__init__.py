"""Web-archive analytics: operators."""
