"""Veilmark: extraction, validation and anonymisation of documents on Spark."""
