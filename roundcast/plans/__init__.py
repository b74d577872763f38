"""Multi-operator jobs and the queries bound to the benchmark tables."""
