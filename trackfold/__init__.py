"""trackfold: sports-tracking analytics expressed as Spark DataFrame plans."""
