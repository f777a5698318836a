"""quire: questions over a shelf of documents, as Spark DataFrame operators."""
