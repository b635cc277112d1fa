"""Worksheet functions: ``from tabulon.functions import fn`` gives them all."""

from . import aggregates, dates, engineering, finance, logic, math, special, text
from .aggregates import AGGREGATES, agg
from .core import FUNCTIONS, Cell, cell, fn

__all__ = ["AGGREGATES", "FUNCTIONS", "Cell", "agg", "aggregates", "cell", "dates", "engineering", "finance", "fn", "logic", "math", "special", "text"]
