"""Coverage comparison over many sources, as Spark DataFrame plans."""
