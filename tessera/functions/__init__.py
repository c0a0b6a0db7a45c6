"""Column-expression libraries: strings, hashing, time, JSON, checked arithmetic."""
