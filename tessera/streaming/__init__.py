"""streaming of tessera."""
