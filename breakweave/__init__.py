"""breakweave: structural-variant, coverage and copy-number analytics as Spark DataFrame operators."""
