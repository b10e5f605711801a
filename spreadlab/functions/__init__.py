"""Column functions: hashes, weights, bit tricks."""
