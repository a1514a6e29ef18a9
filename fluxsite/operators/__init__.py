"""DataFrame operators of the analysis."""
