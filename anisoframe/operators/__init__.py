"""Operators over DataFrames of Gaussians."""
