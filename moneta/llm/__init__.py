"""Operators for building training corpora, each written for Spark at scale."""
