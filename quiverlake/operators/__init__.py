"""Relational vector operators: kNN, k-means, IVF, graph, recall, experiment analytics."""
