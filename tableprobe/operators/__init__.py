"""DataFrame operators: statistics, joins, samples, vectors and models."""
