"""Revision-history analytics on Spark: delta layout, retrieval and reporting as DataFrame plans."""
