"""Collections of embeddings on Spark: ingest, authorization, similarity search and response-log jobs."""
