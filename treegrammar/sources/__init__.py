"""Schema files and document sources."""
