"""siltstone: a Spark-first analytics engine for assay and label tables."""
