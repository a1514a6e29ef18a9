"""Column-expression helpers (NULL/NaN rules and text functions)."""
