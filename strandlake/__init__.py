"""Long-read sequence analytics expressed as Spark DataFrame plans."""
