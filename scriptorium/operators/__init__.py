"""Relational operators over nodes, labels, citations and cells."""
