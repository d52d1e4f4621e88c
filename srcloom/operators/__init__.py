"""Table-to-table operators: extraction, resolution joins, graph, analytics, reports."""
