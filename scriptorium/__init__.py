"""Scriptorium: Spark jobs over corpora of marked-up documents."""
