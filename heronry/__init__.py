"""heronry: evidence retrieval, evaluation and data preparation as Spark plans."""
