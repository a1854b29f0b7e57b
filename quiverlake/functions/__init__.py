"""Column expressions and Arrow kernels over vectors."""
