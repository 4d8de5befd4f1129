"""Vectide: a column algebra on Spark. Named vectors are lazy DataFrame expressions."""
