"""tidewell: hybrid retrieval, retrieval evaluation and run-history analytics on PySpark."""
