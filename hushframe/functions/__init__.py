"""Column expressions and the Arrow kernel."""
