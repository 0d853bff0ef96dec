"""Formulas over streams: those that read the formula's own row only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcalc.errors import FormulaNotSupported
from gridcalc.operators.frames import ROW
from gridcalc.plans.analyze import AGGREGATES, CONDITIONAL, LOOKUPS, check
from gridcalc.plans.compile import Compiler, Options, cell
from gridcalc.plans.parser import parse
from gridcalc.plans.tree import Call, Ref, RefType


def _own_row(node) -> None:
    if isinstance(node, Ref) and (node.kind is not RefType.RR or node.row or not node.is_cell):
        raise FormulaNotSupported(f"{node.text} reads other rows: a stream has none in order")
    if isinstance(node, Call):
        if node.name in AGGREGATES | CONDITIONAL | set(LOOKUPS) | {"MEDIAN"}:
            raise FormulaNotSupported(f"{node.name} reads other rows: a stream has none in order")
        for a in node.args:
            _own_row(a)


def with_formula(stream: DataFrame, formula: str, name: str = "value", precedence: str = "flat") -> DataFrame:
    """Adds a formula over the row's own cells (row 1) to a streaming or batch frame, as a plain projection."""
    tree = parse(formula, precedence)
    _own_row(tree)
    check(tree, 1, len(stream.columns))
    places = {cell(i): F.col(f"`{c}`") for i, c in enumerate(stream.columns)}
    compiler = Compiler(stream.withColumns(places | {ROW: F.lit(1)}), [f.dataType for f in stream.schema.fields], 1, Options())
    compiler._request(tree)
    made = compiler.df.withColumns({m.name: m.build(None) for m in compiler.requests.moving})
    compiler.df = made
    return made.select(*(F.col(f"`{c}`") for c in stream.columns), compiler.value(tree).column.alias(name))
