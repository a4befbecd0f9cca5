"""DataFrame operators of the ensemble analysis."""
