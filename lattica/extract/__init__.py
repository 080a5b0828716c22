"""Source texts as rows: symbols, relations, imports, routes, models, queries, API calls."""
