"""DataFrame operators of the archive engine."""
