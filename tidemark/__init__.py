"""tidemark: a Spark-first library for fact logs, web pages and text corpora."""
