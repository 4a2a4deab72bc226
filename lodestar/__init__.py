"""lodestar: evidence retrieval and evaluation over message archives, as Spark DataFrame programs."""
