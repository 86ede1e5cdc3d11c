"""Column functions: normalization, surface features and term counting."""
