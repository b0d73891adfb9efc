"""Column functions: rolling and cross-sectional operators and the scalars between them."""
