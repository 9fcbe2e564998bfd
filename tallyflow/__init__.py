"""Resource-accounting analytics expressed as PySpark DataFrame operators."""
