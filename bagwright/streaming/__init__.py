"""Event-time windows over streams and tables."""
