"""Queries: compositions of operators over the tables of a folder."""
