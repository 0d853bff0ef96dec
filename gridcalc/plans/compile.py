"""A checked formula tree to one lazy DataFrame plan.

First pass: every window, fixed range and shifted cell is requested once. Then the sheet gets one column a request: fixed
ranges from one aggregate, running and moving windows by gridcalc.operators.frames. Last, the tree becomes a Column over
those; lookups join on the way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcalc.errors import InvalidArguments
from gridcalc.functions.scalar import FUNCTIONS
from gridcalc.operators import aggregates, frames, lookups, medians
from gridcalc.operators.frames import ROW, Moving, Requests, Running
from gridcalc.plans.analyze import AGGREGATES, ARITHMETIC, COMPARISONS, CONDITIONAL
from gridcalc.plans.tree import Call, Literal, Ref, RefType

def cell(index: int) -> str:
    return f"__c{index}"


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "num"
    return "text" if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)) else "bool" if isinstance(data_type, T.BooleanType) else "other"


@dataclass(frozen=True)
class Value:
    column: Column
    kind: str


@dataclass
class Options:
    boundary: str = "null"  # a window past the bottom: "null", or "clip" to the rows there are
    sumif_empty: str = "zero"  # SUMIF without a match: "zero" or "null"
    index_base: int = 0  # the first row and column of INDEX's fixed form


class Compiler:
    def __init__(self, sheet: DataFrame, types: list[T.DataType], rows: int, options: Options):
        self.base, self.df, self.rows, self.options = sheet, sheet, rows, options
        self.kinds = [kind_of(t) for t in types]
        self.types = types
        self.names: dict[tuple, str] = {}
        self.requests = Requests()
        self.fixed: list[tuple[str, Column, tuple[int, int]]] = []
        self.medians: list[tuple[str, Ref]] = []

    def run(self, tree) -> DataFrame:
        self._request(tree)
        self._materialise()
        value = self.value(tree)
        return self.df.select(F.col(ROW).alias("row_id"), value.column.alias("value"))

    # -- first pass ------------------------------------------------------------------------------------------------

    def _request(self, node) -> None:
        if isinstance(node, Ref):
            self._cell(node)
        elif isinstance(node, Call):
            if node.name in AGGREGATES:
                for a in node.args:
                    if isinstance(a, Ref):
                        for part in ("SUM", "COUNT") if node.name == "AVERAGE" else (node.name,):
                            self._aggregate(part, a)
                    else:
                        self._request(a)
            elif node.name in CONDITIONAL:
                for part in self._conditional_parts(node):
                    self._aggregate(*part)
            elif node.name == "MEDIAN":
                self._median(node.args[0])
            elif node.name in ("LOOKUP", "MATCH", "VLOOKUP", "HLOOKUP", "INDEX"):
                for a in self._sources(node):
                    self._request(a)
            else:
                for a in node.args:
                    self._request(a)

    def _sources(self, node: Call) -> list:
        return [node.args[1]] if node.name == "INDEX" else [node.args[0]]

    def _named(self, key: tuple) -> tuple[str, bool]:
        """The column of a request, and whether it is new."""
        if key in self.names:
            return self.names[key], False
        self.names[key] = f"__v{len(self.names)}"
        return self.names[key], True

    def _cell(self, ref: Ref) -> None:
        name, new = self._named(("cell", ref.row, ref.column, ref.kind in (RefType.FF, RefType.FR)))
        if not new:
            return
        source = F.col(cell(ref.column))
        if ref.kind in (RefType.FF, RefType.FR):
            self.fixed.append((name, F.max_by(source, F.when(F.col(ROW) == ref.row + 1, 1)), (ref.row + 1, ref.row + 1)))
        else:
            self.requests.moving.append(Moving(name, ref.row, ref.row, lambda w: source, cell=True))

    def _conditional_parts(self, node: Call) -> list[tuple]:
        first, condition, *third = node.args
        names = {"SUMIF": ("SUM", "COUNT"), "COUNTIF": ("COUNT",), "AVERAGEIF": ("SUM", "COUNT"), "MAXIF": ("MAX",), "MINIF": ("MIN",)}[node.name]
        if node.name == "SUMIF" and self.options.sumif_empty == "zero":
            names = ("SUM",)
        out = third[0] if third else first
        return [(n, first, condition.value, out) for n in names]

    def _contribution(self, name: str, ref: Ref, condition=None, out: Ref | None = None) -> Column:
        tests = None
        if out is not None:
            test = aggregates.criterion(condition)
            tests = [test(F.col(cell(c)), self.kinds[c]) for c in ref.columns]
        # texts count as cells that are there
        cells = [F.col(cell(c)) if name == "COUNT" else aggregates.number(F.col(cell(c)), self.kinds[c]) for c in (out or ref).columns]
        return aggregates.fold(name, cells, tests)

    def _aggregate(self, name: str, ref: Ref, condition=None, out: Ref | None = None) -> None:
        key = ("agg", name, ref, condition, out)
        column, new = self._named(key)
        if not new:
            return
        value, how = self._contribution(name, ref, condition, out), aggregates.COMBINE[name]
        over = frames._AGGREGATES[how]
        if ref.kind is RefType.FF:
            inside = F.col(ROW).between(ref.row + 1, ref.last_row + 1)
            self.fixed.append((column, over(F.when(inside, value)), (ref.row + 1, ref.last_row + 1)))
        elif ref.kind is RefType.RR:
            self.requests.moving.append(Moving(column, ref.row, ref.last_row, lambda w: over(value).over(w)))
        elif ref.kind is RefType.FR:
            self.requests.running.append(Running(column, F.when(F.col(ROW) > ref.row, value), how, True, ref.last_row))
        else:
            self.requests.running.append(Running(column, F.when(F.col(ROW) <= ref.last_row + 1, value), how, False, ref.row))

    def _median(self, ref: Ref) -> None:
        name, new = self._named(("median", ref))
        if not new:
            return
        numbers = [aggregates.number(F.col(cell(c)), self.kinds[c]).cast("double") for c in ref.columns]
        if ref.kind is RefType.RR:
            if len(numbers) == 1:
                build = lambda w: F.percentile(numbers[0], 0.5).over(w)
            else:
                build = lambda w: aggregates.middle(F.filter(F.flatten(F.collect_list(F.array(*numbers)).over(w)), lambda x: x.isNotNull()))
            self.requests.moving.append(Moving(name, ref.row, ref.last_row, build))
        else:
            self.medians.append((name, ref))

    # -- the requests' columns -------------------------------------------------------------------------------------

    def _materialise(self) -> None:
        if self.fixed:
            low, high = min(r[0] for _, _, r in self.fixed), max(r[1] for _, _, r in self.fixed)
            one = self.base.where(F.col(ROW).between(low, high)).agg(*(c.alias(n) for n, c, _ in self.fixed))
            self.df = self.df.crossJoin(F.broadcast(one))  # one row
        for name, ref in self.medians:
            self.df = self._fixed_median(name, ref) if ref.kind is RefType.FF else self._running_median(name, ref)
        self.df = frames.apply(self.df, self.rows, self.requests)

    def _cells(self, ref: Ref) -> DataFrame:
        """The range's cells, one a row, of the rows inside the fixed end."""
        rows = self.base
        if ref.kind is not RefType.RF:
            rows = rows.where(F.col(ROW) > ref.row)
        if ref.kind is not RefType.FR:
            rows = rows.where(F.col(ROW) <= ref.last_row + 1)
        numbers = F.array(*(aggregates.number(F.col(cell(c)), self.kinds[c]).cast("double") for c in ref.columns))
        return rows.select(ROW, F.explode(numbers).alias("x"))

    def _fixed_median(self, name: str, ref: Ref) -> DataFrame:
        return self.df.crossJoin(F.broadcast(self._cells(ref).agg(F.percentile("x", 0.5).alias(name))))  # one row

    def _running_median(self, name: str, ref: Ref) -> DataFrame:
        """Every row's median over all cells up to it; rows are asked about in the order of the window's growth."""
        forward = ref.kind is RefType.FR
        offset = ref.last_row if forward else ref.row
        found = medians.running(self._cells(ref), F.col(ROW) if forward else -F.col(ROW), self.rows * len(ref.columns))
        own = F.col("__at") if forward else -F.col("__at")
        at = found.select((own - offset).alias("__at"), F.col("median").alias(name))
        if forward and self.options.boundary == "clip":  # rows whose last cell lies below the bottom see them all
            asked = F.least(F.col(ROW), F.lit(self.rows - offset))
        else:
            asked = F.col(ROW)
        return self.df.withColumn("__ask", asked).join(at, F.col("__ask") == F.col("__at"), "left").drop("__ask", "__at")

    # -- the tree --------------------------------------------------------------------------------------------------

    def _outside(self, ref: Ref) -> Column | None:
        """Where the reference reaches below the bottom, if that makes the result null."""
        reach = {RefType.RR: ref.last_row, RefType.FR: ref.last_row, RefType.RF: ref.row, RefType.FF: 0}[ref.kind]
        return F.col(ROW) + reach > self.rows if reach and self.options.boundary == "null" and ref.kind is not RefType.RF else None

    def _over(self, name: str, ref: Ref, condition=None, out: Ref | None = None) -> Column:
        key = ("agg", name, ref, condition, out)
        found = F.col(self.names[key])
        if ref.kind is RefType.FR and self.options.boundary == "clip" and ref.last_row:
            # below the bottom: all rows from the fixed first one
            whole = self._whole(name, ref, condition, out)
            found = F.when(F.col(ROW) + ref.last_row > self.rows, whole).otherwise(found)
        if name == "COUNT":
            found = F.coalesce(found, F.lit(0).cast("long"))
        outside = self._outside(ref)
        return found if outside is None else F.when(~outside, found)

    def _whole(self, name: str, ref: Ref, condition, out) -> Column:
        key = ("whole", name, ref, condition, out)
        column, new = self._named(key)
        if new:
            over = frames._AGGREGATES[aggregates.COMBINE[name]]
            one = self.base.where(F.col(ROW) > ref.row).agg(over(self._contribution(name, ref, condition, out)).alias(column))
            self.df = self.df.crossJoin(F.broadcast(one))  # one row
        return F.col(column)

    def number(self, v: Value) -> Column:
        if v.kind == "num":
            return v.column
        return v.column.cast("int") if v.kind == "bool" else v.column.try_cast("double")

    def text(self, v: Value) -> Column:
        """A value as text; whole numbers without a decimal point."""
        if v.kind == "num":
            return F.regexp_replace(v.column.cast("string"), r"\.0$", "")
        return v.column if v.kind == "text" else v.column.cast("string")

    def value(self, node) -> Value:
        if isinstance(node, Literal):
            if node.value is None:
                return Value(F.lit(None), "null")
            return Value(F.lit(node.value), "bool" if isinstance(node.value, bool) else "num" if isinstance(node.value, float) else "text")
        if isinstance(node, Ref):
            return Value(F.col(self.names["cell", node.row, node.column, node.kind in (RefType.FF, RefType.FR)]), self.kinds[node.column])
        name = node.name
        if name in AGGREGATES:
            return Value(self._aggregated(node), "num")
        if name in CONDITIONAL:
            return Value(self._conditional(node), "num")
        if name == "MEDIAN":
            ref = node.args[0]
            outside = self._outside(ref)
            found = F.col(self.names["median", ref])
            return Value(found if outside is None else F.when(~outside, found), "num")
        if name == "IF":
            condition, then, other = (self.value(a) for a in node.args)
            test = condition.column if condition.kind in ("bool", "null") else self.number(condition) != 0
            kind = then.kind if then.kind != "null" else other.kind
            if {then.kind, other.kind} == {"num", "text"}:
                kind, then, other = "text", Value(self.text(then), "text"), Value(self.text(other), "text")
            return Value(F.when(test.cast("boolean"), then.column).otherwise(other.column), kind)
        if name in COMPARISONS:
            return self._compared(name, *(self.value(a) for a in node.args))
        if name in ARITHMETIC:
            return self._arithmetic(name, *(self.value(a) for a in node.args))
        if name in ("LOOKUP", "MATCH", "VLOOKUP", "HLOOKUP"):
            return self._lookup(node)
        if name == "INDEX":
            return self._index(node)
        f = FUNCTIONS[name]
        args = []
        for k, a in enumerate(node.args):
            takes = f.takes[min(k, len(f.takes) - 1)]
            v = self.value(a)
            if takes == "t":
                column = self.text(v)
                if isinstance(a, Literal) and isinstance(a.value, float) and a.value == int(a.value):
                    column = F.lit(str(int(a.value)))
                args.append(column)
            else:
                args.append(v.column if takes == "a" else self.number(v).cast("double"))
        return Value(f.build(*args), f.gives)

    def _arithmetic(self, op: str, a: Value, b: Value) -> Value:
        if op == "+" and a.kind == b.kind == "text":
            return Value(F.concat(a.column, b.column), "text")
        x, y = self.number(a), self.number(b)
        if op == "/":
            return Value(F.try_divide(x.cast("double"), y.cast("double")), "num")
        return Value({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y), "num")

    def _compared(self, op: str, a: Value, b: Value) -> Value:
        if {a.kind, b.kind} <= {"num", "bool"} and a.kind != b.kind:
            x, y = self.number(a), self.number(b)
        elif {a.kind, b.kind} == {"num", "text"}:
            x, y = self.number(a), self.number(b)
        else:
            x, y = a.column, b.column
        return Value({"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], "bool")

    def _aggregated(self, node: Call) -> Column:
        if node.name == "AVERAGE":
            total, count = self._combined("SUM", node), self._combined("COUNT", node)
            return F.try_divide(total.cast("double"), count.cast("double"))
        return self._combined(node.name, node)

    def _combined(self, name: str, node: Call) -> Column:
        parts, outside = [], []
        for a in node.args:
            if isinstance(a, Ref):
                parts.append(self._over(name, a))
                if (o := self._outside(a)) is not None:
                    outside.append(o)
            elif name == "COUNT":
                parts.append(F.lit(1) if isinstance(a, Literal) else self.value(a).column.isNotNull().cast("long"))
            else:
                parts.append(self.number(self.value(a)))
        if len(parts) == 1:
            return parts[0]
        if name in ("SUM", "COUNT"):
            out = F.coalesce(parts[0], F.lit(0))
            for p in parts[1:]:
                out = out + F.coalesce(p, F.lit(0))
            some = parts[0].isNotNull()
            for p in parts[1:]:
                some = some | p.isNotNull()
            out = F.when(some, out)
        else:
            out = (F.greatest if name == "MAX" else F.least)(*parts)
        for o in outside:
            out = F.when(~o, out)
        return out

    def _conditional(self, node: Call) -> Column:
        found = {p[0]: self._over(*p) for p in self._conditional_parts(node)}
        if node.name == "SUMIF":
            return found["SUM"] if self.options.sumif_empty == "zero" else F.when(found["COUNT"] > 0, found["SUM"])
        if node.name == "AVERAGEIF":
            return F.try_divide(found["SUM"].cast("double"), found["COUNT"].cast("double"))
        return next(iter(found.values()))

    # -- lookups ---------------------------------------------------------------------------------------------------

    def _fixed_rows(self, ref, what: str) -> DataFrame:
        if not isinstance(ref, Ref) or ref.kind is not RefType.FF:
            raise InvalidArguments(f"{what} needs a fixed range")
        return self.base.where(F.col(ROW).between(ref.row + 1, ref.last_row + 1))

    def _height(self, ref: Ref) -> int:
        return min(self.rows, ref.last_row - ref.row + 1)

    def _cell_at(self, row: Column, column: int, name: str, within: Ref | None) -> DataFrame:
        """The rows with the cell of a computed row; of a fixed range, only its own rows take part."""
        cells = self._fixed_rows(within, "a fixed range") if within else self.base
        cells = cells.select(F.col(ROW).alias("row"), F.col(cell(column)).alias("target"))
        return lookups.join_row(self.df, row, cells, name, self.rows, self._height(within) if within else self.rows)

    def _literal(self, node, what: str) -> int:
        if isinstance(node, Call) and node.name == "NEGATE":
            return -self._literal(node.args[0], what)
        if not isinstance(node, Literal) or not isinstance(node.value, (float, bool)):
            raise InvalidArguments(f"{what} must be a number")
        return int(node.value)

    def _lookup(self, node: Call) -> Value:
        name, args = node.name, node.args
        source = self.value(args[0])
        if name == "HLOOKUP":
            return self._hlookup(node, source)
        search = args[1]
        rows = self._fixed_rows(search, name)
        if name == "LOOKUP":
            target, mode = args[2], self._literal(args[3], "LOOKUP's mode")
            self._fixed_rows(target, name)
            shift, column = target.row - search.row, target.column
        elif name == "VLOOKUP":
            column = search.column + self._literal(args[2], "VLOOKUP's column") - 1
            if not search.column <= column <= search.last_column:
                raise InvalidArguments(f"VLOOKUP's column lies outside {search.text}")
            mode, shift = (self._literal(args[3], "VLOOKUP's mode") if len(args) > 3 else 0), 0
        else:
            column, shift, mode = None, 0, self._literal(args[2], "MATCH's mode") if len(args) > 2 else 0
        if mode not in (0, 1, -1):
            raise InvalidArguments(f"{name}'s mode is 0, 1 or -1")
        key = F.col(cell(search.column))
        numeric = "num" in (source.kind, self.kinds[search.column])
        if numeric:
            key, asked = self.number(Value(key, self.kinds[search.column])).cast("double"), self.number(source).cast("double")
        else:
            asked = source.column
        within = target if name == "LOOKUP" else search
        goal = F.lit(None).cast("int") if column is None or shift else F.col(cell(column))
        searched = rows.select(key.alias("key"), F.col(ROW).alias("row"), goal.alias("target"))
        column_name, _ = self._named(("lookup", node, len(self.names)))
        if mode == 0:
            hits, most = lookups.exact(searched), self._height(search)
        else:
            hits, most = lookups.positional(searched, lookups.distinct_sources(self.df, asked), mode == 1, self.rows), self.rows
        self.df = lookups.join_key(self.df, asked, hits, column_name, self.rows, most)
        hit = F.col(column_name)
        if column is None:
            return Value((hit["row"] - search.row).cast("long"), "num")
        if shift:
            at = hit["row"] + shift
            at = F.when(at.between(within.row + 1, within.last_row + 1), at)
            self.df = self._cell_at(at, column, f"{column_name}t", within)
            return Value(F.col(f"{column_name}t"), self.kinds[column])
        return Value(F.when(hit["row"] <= within.last_row + 1, hit["target"]), self.kinds[column])

    def _hlookup(self, node: Call, source: Value) -> Value:
        """Exact search in the range's first row; of the column found, the cell of the given row (from 1)."""
        ref, row = node.args[1], self._literal(node.args[2], "HLOOKUP's row")
        self._fixed_rows(ref, "HLOOKUP")
        if not 1 <= row <= ref.last_row - ref.row + 1:
            raise InvalidArguments(f"HLOOKUP's row lies outside {ref.text}")
        kinds = {self.kinds[c] for c in ref.columns}
        as_text = len(kinds) > 1
        names = [(f"__h{len(self.names)}_{c}", f"__g{len(self.names)}_{c}") for c in ref.columns]
        self._named(("hlookup", node, len(self.names)))
        at = lambda c, r: F.max_by(F.col(cell(c)), F.when(F.col(ROW) == r, 1))
        one = self.base.where(F.col(ROW).isin(ref.row + 1, ref.row + row)).agg(*(x for (h, g), c in zip(names, ref.columns, strict=True) for x in (at(c, ref.row + 1).alias(h), at(c, ref.row + row).alias(g))))
        self.df = self.df.crossJoin(F.broadcast(one))  # one row
        cases = []
        for (h, g), c in zip(names, ref.columns, strict=True):
            same = self._compared("=", Value(F.col(h), self.kinds[c]), source).column
            cases.append(F.when(same, F.col(g).cast("string") if as_text else F.col(g)))
        return Value(F.coalesce(*cases), "text" if as_text else kinds.pop())

    def _index(self, node: Call) -> Value:
        ref, base = node.args[0], self.options.index_base
        if not isinstance(ref, Ref):
            raise InvalidArguments(f"INDEX takes a range: {node.text}")
        at = self.number(self.value(node.args[1])).cast("long")
        column = ref.column + (self._literal(node.args[2], "INDEX's column") - base if len(node.args) > 2 else 0)
        if not ref.column <= column <= ref.last_column:
            raise InvalidArguments(f"INDEX's column lies outside {ref.text}")
        if ref.kind is RefType.FF:
            # absolute in the sheet, from index_base, inside the range
            row = at + 1 - base
            row = F.when(row.between(ref.row + 1, ref.last_row + 1), row)
        else:
            first = F.lit(ref.row + 1) if ref.kind is RefType.FR else F.col(ROW) + ref.row
            last = F.lit(ref.last_row + 1) if ref.kind is RefType.RF else F.col(ROW) + ref.last_row
            row = F.when((at >= 1) & (first + at - 1 <= last), first + at - 1)
        name, _ = self._named(("index", node, len(self.names)))
        self.df = self._cell_at(row, column, name, ref if ref.kind is RefType.FF else None)
        return Value(F.col(name), self.kinds[column])
