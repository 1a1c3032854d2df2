"""Column functions and small statistical kernels."""
