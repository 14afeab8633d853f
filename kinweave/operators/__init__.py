"""Table-level operators: joins, keyed updates, matching, ranking, aggregation."""
