"""Aggregates of ranges: criteria, a row's contribution, and how arguments combine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridcalc.errors import InvalidArguments

_CRITERION = re.compile(r"\s*(<>|<=|>=|=|<|>)?\s*(.*?)\s*$", re.DOTALL)
_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")


def criterion(condition: object):
    """A test of a cell for a criterion such as ">15", "<>x" or 3; null cells never match."""
    if isinstance(condition, (int, float)) and not isinstance(condition, bool):
        op, value = "=", float(condition)
    elif isinstance(condition, str):
        m = _CRITERION.match(condition)
        op, text = m[1] or "=", m[2]
        value = float(text) if _NUMBER.match(text) else text.strip("'")
    else:
        raise InvalidArguments(f"not a criterion: {condition!r}")

    def test(cell: Column, kind: str) -> Column:
        if isinstance(value, float):
            left, right = (cell.try_cast("double") if kind == "text" else cell.cast("double")), F.lit(value)
        else:
            left, right = cell.cast("string"), F.lit(value)
        return {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]

    return test


def number(cell: Column, kind: str) -> Column:
    """A cell as aggregates take it: logical values count as 0 and 1, texts as numbers where they are."""
    if kind == "bool":
        return cell.cast("int")
    return cell.try_cast("double") if kind == "text" else cell


def fold(name: str, cells: list[Column], tests: list[Column] | None = None) -> Column:
    """One row's contribution to SUM, COUNT, MAX or MIN over the range's columns; tests as of the *IF functions."""
    if tests is not None:
        cells = [F.when(t, c) for t, c in zip(tests, cells, strict=True)]
    if name == "SUM":
        out = F.coalesce(cells[0], F.lit(0))
        for c in cells[1:]:
            out = out + F.coalesce(c, F.lit(0))
        return out
    if name == "COUNT":
        out = cells[0].isNotNull().cast("long")
        for c in cells[1:]:
            out = out + c.isNotNull().cast("long")
        return out
    if len(cells) == 1:
        return cells[0]
    return (F.greatest if name == "MAX" else F.least)(*cells)


COMBINE = {"SUM": "sum", "COUNT": "sum", "MAX": "max", "MIN": "min"}


def middle(values: Column) -> Column:
    """Median of an array without nulls."""
    a = F.array_sort(values)
    n = F.size(a)
    at = lambda k: F.get(a, k).cast("double")
    return F.when(n > 0, (at(F.floor((n - 1) / 2).cast("int")) + at(F.floor(n / 2).cast("int"))) / 2)
