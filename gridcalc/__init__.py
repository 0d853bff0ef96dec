"""Spreadsheet formulas over large tables, as Spark plans."""

from gridcalc.functions.scalar import register
from gridcalc.sheet import Sheet

__all__ = ["Sheet", "register"]
