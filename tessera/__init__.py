"""tessera: an analytics engine for evidence stores, written for PySpark."""
