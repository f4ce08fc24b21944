"""Lodestone: retrieval, document analytics and corpus preparation as Spark plans."""
