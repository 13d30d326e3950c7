"""Operators of a training-data pipeline on the tables documents, pages and labels."""
