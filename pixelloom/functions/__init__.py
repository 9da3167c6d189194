"""Column functions: spectral indices, scores, projections, classification."""
