"""Analytics for large photo shoots and the tables around them, on PySpark."""
