"""Queries over the given tables. Importing the package registers all of them."""

from scriptorium.plans import grids, markup, queries, scopes, sources, typesetting  # noqa: F401
