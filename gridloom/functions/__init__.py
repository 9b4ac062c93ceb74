"""Spreadsheet functions as Spark expressions."""

from . import dates, financial, information, logical, maths, statistics, texts, vectors  # noqa: F401
from .registry import CATALOG, call, functions, over, register_function, register_names

__all__ = ["CATALOG", "call", "functions", "over", "register_function", "register_names"]
