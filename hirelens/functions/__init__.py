"""Column expressions. Everything here is lazy and row-local."""
