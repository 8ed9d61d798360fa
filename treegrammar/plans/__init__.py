"""Schema compiler, pattern pool and the catalogue of queries."""
