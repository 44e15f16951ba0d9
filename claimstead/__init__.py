"""Claims, evidence, retrieval and accountability as Spark DataFrame operators."""
