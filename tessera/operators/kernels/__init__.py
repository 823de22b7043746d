"""NumPy kernels for one mesh at a time."""
