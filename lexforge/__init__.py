"""lexforge: retrieval, ranking and text analytics as PySpark DataFrame operators."""
