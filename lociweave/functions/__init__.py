"""Expressions: everything here compiles to Spark columns."""
