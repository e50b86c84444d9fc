"""Scholium: literature-corpus analytics as Spark DataFrame plans."""
