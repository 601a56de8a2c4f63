"""Document kernels (numpy, no Spark) and the DataFrame operators built on them."""
