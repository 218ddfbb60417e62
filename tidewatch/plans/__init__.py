"""Whole jobs made of operators: result documents, the refresh cycle, the query registry."""
