"""Record files and synthetic records."""
