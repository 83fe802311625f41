"""Web-archive analytics: functions."""
