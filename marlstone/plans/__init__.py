"""Query catalogues over the standard tables."""
