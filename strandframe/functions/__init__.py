"""Column functions: CIGAR strings, flags, bins."""
