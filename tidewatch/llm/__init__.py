"""Operators of a training-data pipeline. Nothing else in the library imports them."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
