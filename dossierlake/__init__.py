"""Document-compliance analytics expressed as Spark DataFrame plans."""
