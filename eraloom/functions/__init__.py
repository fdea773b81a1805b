"""Column expressions and scale-safe ordered primitives."""
