"""quarry: code intelligence and corpus processing as Spark DataFrame plans."""
