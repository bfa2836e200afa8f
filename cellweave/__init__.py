"""cellweave: spatial single-cell analytics as Spark DataFrame operators."""
