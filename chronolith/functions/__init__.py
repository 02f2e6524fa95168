"""Column functions and byte-level kernels."""
