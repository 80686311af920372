"""Evidence retrieval, conversation ledgers and their evaluation as Spark jobs."""
