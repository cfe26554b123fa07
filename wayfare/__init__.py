"""wayfare: mobility and sensor analytics expressed as Spark DataFrame plans."""
