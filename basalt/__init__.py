"""Hybrid retrieval, graph, task, timer and text operators as Spark DataFrame plans."""
