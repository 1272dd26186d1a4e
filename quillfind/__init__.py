"""Quillfind: retrieval and evaluation over text corpora as set-oriented Spark plans."""
