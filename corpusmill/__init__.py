"""corpusmill: preparing and measuring language-model training data on Spark."""
