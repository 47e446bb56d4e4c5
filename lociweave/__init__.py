"""Genomic annotation and interval analytics as Spark DataFrame plans."""
