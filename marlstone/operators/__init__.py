"""Search, statistics, taxonomies, categorisers and mappings."""
