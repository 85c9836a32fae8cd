"""Sources: files, listings, databases and landed service payloads."""
