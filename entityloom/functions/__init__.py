"""Column expressions: scalar transforms, fixed-point statistics, array kernels."""
