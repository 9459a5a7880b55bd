"""DataFrame operators: hierarchy, joins, checks, partitioning, spatial queries, comparison."""
