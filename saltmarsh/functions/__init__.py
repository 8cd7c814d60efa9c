"""Column expressions and the small rule tables they need."""
