"""Veinstone: evidence retrieval and corpus analytics as Spark plans."""
