"""A Spark-first engine for document graphs: chunking, extraction, entity
resolution, graph analytics, vector search and fused retrieval."""
