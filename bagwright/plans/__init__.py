"""What queries mean: value domains, lineage, exactness, counts and bundles of statements."""
