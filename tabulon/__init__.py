"""Tabulon: analytics over document-derived tables, as Spark DataFrame transformations."""
