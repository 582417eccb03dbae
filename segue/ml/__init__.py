"""Clustering in the weighted feature space."""
