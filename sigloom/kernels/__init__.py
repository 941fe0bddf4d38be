"""numpy kernels on one read. Matrices are (blocks, features), double precision; states put stay last."""
