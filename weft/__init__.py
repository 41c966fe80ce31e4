"""weft: line-network analytics as Spark DataFrame plans."""
