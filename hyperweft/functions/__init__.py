"""Statistics and numeric kernels."""
