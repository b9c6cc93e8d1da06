"""Column expressions for text, features, networks and time."""
