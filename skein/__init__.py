"""Web-measurement analytics on PySpark."""
