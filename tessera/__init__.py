"""tessera: hybrid document search and analytics expressed as Spark DataFrame plans."""
