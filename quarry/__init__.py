"""Quarry: a relational analytics engine on PySpark."""
