"""Report-labelling and model-evaluation jobs as plain Spark DataFrame plans."""
