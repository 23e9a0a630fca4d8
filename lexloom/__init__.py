"""lexloom: text-corpus construction and analytics as Spark DataFrame plans."""
