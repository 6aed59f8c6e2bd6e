"""DataFrame-to-DataFrame operators: graph, catalog, documents, stores, search."""
