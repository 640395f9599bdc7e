"""Compilers from query languages to Catalyst columns, and the query registry."""
