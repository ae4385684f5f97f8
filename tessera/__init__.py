"""Text to knowledge graph to question/answer datasets, on Spark."""
