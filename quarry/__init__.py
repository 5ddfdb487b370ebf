"""Document-corpus indexing and evidence retrieval on Spark."""
