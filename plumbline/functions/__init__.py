"""Statistical functions: closed forms as columns, kernels as vectorised functions of arrays."""
