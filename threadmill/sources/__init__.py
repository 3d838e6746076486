"""Table sources, fixture views and sinks."""
