"""Label and series analytics as ordinary Spark DataFrame plans."""
