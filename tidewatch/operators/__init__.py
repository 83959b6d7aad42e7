"""DataFrame operators: keyed tables, incremental keys, ordered neighbours, quality checks."""
