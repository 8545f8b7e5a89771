"""Graphs, state hypergraphs and trace analytics as Spark DataFrame operations."""
