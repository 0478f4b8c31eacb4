"""Dataset curation and evaluation as Spark DataFrame operators."""
