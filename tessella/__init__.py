"""Tessella: a Spark-first engine for document corpora, retrieval and evaluation."""
