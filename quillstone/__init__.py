"""A content preparation, retrieval and evaluation engine on PySpark."""
