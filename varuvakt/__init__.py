"""Catalogue, price-watch and description analytics as Spark DataFrame jobs."""
