"""A retrieval and analytics engine on PySpark."""
