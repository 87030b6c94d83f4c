"""Spark operators for tables of labelled text and vectors."""
