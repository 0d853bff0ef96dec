"""Registered queries: one or more for every function and operator, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcalc.sheet import Sheet

KEYS = {
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
    "customer": ["c_custkey"],
    "part": ["p_partkey"],
    "supplier": ["s_suppkey"],
    "orders": ["o_orderkey"],
}
#: d: doubles that are exact at six places; s: long running sums of cents; a: long running means, shifted off exact halves.
_CASTS = {
    "d": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0), "s": lambda c: F.round(c.cast("double"), 4), "a": lambda c: F.round(c.cast("double") + F.lit(0.00123), 2),
    "i": lambda c: c.cast("long"), "t": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean"),
}
_SQL_CASTS = {"d": "round(CAST({} AS DOUBLE), 6) + 0.0", "s": "round(CAST({} AS DOUBLE), 4)", "a": "round(CAST({} AS DOUBLE) + 0.00123, 2)", "i": "CAST({} AS BIGINT)", "t": "CAST({} AS VARCHAR)", "b": "CAST({} AS BOOLEAN)"}


@dataclass
class Spec:
    table: str
    formula: str  # {n}: the sheet's row count
    sql: str | None  # over b(row_id, n, the table's columns); None where results are random
    kind: str = "d"
    options: dict = field(default_factory=dict)
    joins: str = ""


def _frame(first: str, last: str) -> str:
    return f"OVER (ORDER BY row_id ROWS BETWEEN {first} AND {last})"


def _below(k: int) -> str:
    return f"{k} FOLLOWING"


SPECS: dict[str, Spec] = {}


def _aggregates() -> None:
    """Every aggregate with every kind of reference, over l_quantity and l_extendedprice."""
    e, f = "l_quantity", "l_extendedprice"
    row = {"sum": f"coalesce({e}, 0) + coalesce({f}, 0)", "count": f"CAST({e} IS NOT NULL AS INT) + CAST({f} IS NOT NULL AS INT)", "max": f"greatest({e}, {f})", "min": f"least({e}, {f})"}
    hit = {"sum": f"CASE WHEN {e} > 25 THEN {e} ELSE 0 END + CASE WHEN {f} > 25 THEN {f} ELSE 0 END", "count": f"CAST({e} > 25 AS INT) + CAST({f} > 25 AS INT)", "max": f"greatest(CASE WHEN {e} > 25 THEN {e} END, CASE WHEN {f} > 25 THEN {f} END)", "min": f"least(CASE WHEN {e} > 25 THEN {e} END, CASE WHEN {f} > 25 THEN {f} END)"}
    over = {"sum": "sum", "count": "sum", "max": "max", "min": "min"}
    refs = {
        "rr": ("E1:F3", lambda fn, x: f"CASE WHEN row_id + 2 <= n THEN {fn}({x}) {_frame('CURRENT ROW', _below(2))} END"),
        "fr": ("E$3:F2", lambda fn, x: f"CASE WHEN row_id + 1 <= n THEN {fn}(CASE WHEN row_id >= 3 THEN {x} END) {_frame('UNBOUNDED PRECEDING', _below(1))} END"),
        "rf": ("E2:F$50", lambda fn, x: f"{fn}(CASE WHEN row_id <= 50 THEN {x} END) {_frame(_below(1), 'UNBOUNDED FOLLOWING')}"),
        "ff": ("E$3:F$40", lambda fn, x: f"(SELECT {fn}({x}) FROM b WHERE row_id BETWEEN 3 AND 40)"),
        "rf_whole": ("E2:F${n}", lambda fn, x: f"{fn}({x}) {_frame(_below(1), 'UNBOUNDED FOLLOWING')}"),
        "ff_whole": ("E$1:F${n}", lambda fn, x: f"(SELECT {fn}({x}) FROM b)"),
    }
    long = ("fr", "rf_whole", "ff_whole")
    for kind, (ref, sql) in refs.items():
        count = lambda x: f"coalesce({x}, 0)" if kind != "rr" and kind != "fr" else x  # noqa: B023, E731
        for prefix, cells, suffix in (("agg", row, ""), ("aggif", hit, "if")):
            call = (lambda name: f'={name}IF({ref},">25")') if suffix else (lambda name: f"={name}({ref})")  # noqa: B023
            for fn in ("sum", "max", "min"):
                SPECS[f"{prefix}_{fn}{suffix}_{kind}"] = Spec("lineitem", call(fn.upper()), sql(over[fn], cells[fn]), "s" if kind in long else "d")
            outside = {"rr": 2, "fr": 1}.get(kind)
            counted = sql("sum", cells["count"])
            counted = f"CASE WHEN row_id + {outside} <= n THEN coalesce({counted}, 0) END" if outside else count(counted)
            SPECS[f"{prefix}_count{suffix}_{kind}"] = Spec("lineitem", call("COUNT"), counted, "i")
            SPECS[f"{prefix}_average{suffix}_{kind}"] = Spec("lineitem", call("AVERAGE"), f"({sql('sum', cells['sum'])}) / nullif({sql('sum', cells['count'])}, 0)", "a" if kind in long else "d")
    three = lambda fn, x: f"{fn}({x}) {_frame('CURRENT ROW', _below(2))}"
    SPECS["agg_sum_multi_literal"] = Spec("lineitem", "=SUM(E1:F3,10)", f"CASE WHEN row_id + 2 <= n THEN {three('sum', row['sum'])} + 10 END")
    SPECS["agg_sum_multi_ranges"] = Spec("lineitem", "=SUM(E1:F2,G$1:H1)", f"CASE WHEN row_id + 1 <= n THEN sum({row['sum']}) {_frame('CURRENT ROW', _below(1))} + sum(l_discount + l_tax) {_frame('UNBOUNDED PRECEDING', 'CURRENT ROW')} END")
    SPECS["agg_count_multi"] = Spec("lineitem", "=COUNT(E1:F3,F1:F2,7)", "CASE WHEN row_id + 2 <= n THEN 6 + 2 + 1 END", "i")
    SPECS["agg_min_multi"] = Spec("lineitem", "=MIN(E1:F3,E$1,30)", f"CASE WHEN row_id + 2 <= n THEN least({three('min', row['min'])}, (SELECT l_quantity FROM b WHERE row_id = 1), 30) END")
    SPECS["agg_max_multi"] = Spec("lineitem", "=MAX(E1:F3,E$1:F1)", f"CASE WHEN row_id + 2 <= n THEN greatest({three('max', row['max'])}, max({row['max']}) {_frame('UNBOUNDED PRECEDING', 'CURRENT ROW')}) END")
    SPECS["agg_average_multi"] = Spec("lineitem", "=AVERAGE(E1:F3,E$1,1)", f"CASE WHEN row_id + 2 <= n THEN ({three('sum', row['sum'])} + (SELECT l_quantity FROM b WHERE row_id = 1) + 1) / 8.0 END")
    SPECS["agg_sum_expression"] = Spec("lineitem", "=SUM(E1+F1,G1:G2)", f"CASE WHEN row_id + 1 <= n THEN l_quantity + l_extendedprice + sum(l_discount) {_frame('CURRENT ROW', _below(1))} END")
    clip = {"boundary": "clip", "sumif_empty": "null"}
    SPECS["agg_sum_rr_clip"] = Spec("lineitem", "=SUM(E1:F3)", three("sum", row["sum"]), options=clip)
    SPECS["agg_sum_fr_clip"] = Spec("lineitem", "=SUM(E$1:F3)", f"sum({row['sum']}) {_frame('UNBOUNDED PRECEDING', _below(2))}", "s", options=clip)
    SPECS["aggif_sumif_empty_null"] = Spec("lineitem", '=SUMIF(E1:E2,">49")', f"CASE WHEN sum(CAST(l_quantity > 49 AS INT)) {_frame('CURRENT ROW', _below(1))} > 0 THEN sum(CASE WHEN l_quantity > 49 THEN l_quantity ELSE 0 END) {_frame('CURRENT ROW', _below(1))} END", options=clip)
    SPECS["aggif_sumif_third"] = Spec("lineitem", '=SUMIF(E1:E3,"<>24",F1:F3)', f"CASE WHEN row_id + 2 <= n THEN sum(CASE WHEN l_quantity <> 24 THEN l_extendedprice ELSE 0 END) {_frame('CURRENT ROW', _below(2))} END")
    SPECS["aggif_countif_text"] = Spec("lineitem", '=COUNTIF(I1:I5,"R")', f"CASE WHEN row_id + 4 <= n THEN sum(CAST(l_returnflag = 'R' AS INT)) {_frame('CURRENT ROW', _below(4))} END", "i")
    SPECS["agg_median_rr"] = Spec("lineitem", "=MEDIAN(E1:E5)", f"CASE WHEN row_id + 4 <= n THEN quantile_cont(l_quantity, 0.5) {_frame('CURRENT ROW', _below(4))} END")
    SPECS["agg_median_rr_columns"] = Spec("customer", "=MEDIAN(C1:D2)", "CASE WHEN row_id + 1 <= n THEN list_median(list_value(CAST(c_nationkey AS DOUBLE), c_acctbal, CAST(lead(c_nationkey) OVER (ORDER BY row_id) AS DOUBLE), lead(c_acctbal) OVER (ORDER BY row_id))) END")
    SPECS["agg_median_fr"] = Spec("supplier", "=MEDIAN(D$1:D1)", f"quantile_cont(s_acctbal, 0.5) {_frame('UNBOUNDED PRECEDING', 'CURRENT ROW')}")
    SPECS["agg_median_rf"] = Spec("supplier", "=MEDIAN(D1:D$8)", f"quantile_cont(CASE WHEN row_id <= 8 THEN s_acctbal END, 0.5) {_frame('CURRENT ROW', 'UNBOUNDED FOLLOWING')}")
    SPECS["agg_median_rf_whole"] = Spec("supplier", "=MEDIAN(D1:D${n})", f"quantile_cont(s_acctbal, 0.5) {_frame('CURRENT ROW', 'UNBOUNDED FOLLOWING')}")
    SPECS["agg_median_ff"] = Spec("lineitem", "=MEDIAN(E$3:F$40)", "(SELECT quantile_cont(x, 0.5) FROM (SELECT l_quantity AS x FROM b WHERE row_id BETWEEN 3 AND 40 UNION ALL SELECT l_extendedprice FROM b WHERE row_id BETWEEN 3 AND 40))")


def _arithmetic() -> None:
    lead = lambda c, k: f"lead({c}, {k}) OVER (ORDER BY row_id)"
    for name, op in (("add", "+"), ("subtract", "-"), ("multiply", "*")):
        SPECS[f"arith_{name}"] = Spec("lineitem", f"=E1{op}F2", f"l_quantity {op} {lead('l_extendedprice', 1)}")
    SPECS["arith_divide"] = Spec("lineitem", "=E1/G2", f"l_quantity / nullif({lead('l_discount', 1)}, 0)")
    SPECS["arith_negate"] = Spec("customer", "=-D1", "-c_acctbal")
    SPECS["arith_mixed_offsets"] = Spec("lineitem", "=E1+F2-G3", f"l_quantity + {lead('l_extendedprice', 1)} - {lead('l_discount', 2)}")
    SPECS["arith_flat_precedence"] = Spec("lineitem", "=E1+F1*G1", "(l_quantity + l_extendedprice) * l_discount")
    SPECS["arith_excel_precedence"] = Spec("lineitem", "=E1+F1*G1^2", "l_quantity + l_extendedprice * l_discount * l_discount", options={"precedence": "excel"})
    SPECS["arith_percent"] = Spec("lineitem", "=E1%", "l_quantity / 100")
    SPECS["arith_concat_sign"] = Spec("part", "=B1&C1", "p_name || p_brand", "t")
    SPECS["arith_fixed_cells"] = Spec("lineitem", "=E$2*F$3", "(SELECT l_quantity FROM b WHERE row_id = 2) * (SELECT l_extendedprice FROM b WHERE row_id = 3)")
    SPECS["arith_constant"] = Spec("supplier", "=1+2", "3")
    SPECS["arith_bare_reference"] = Spec("part", "=B2", lead("p_name", 1), "t")
    for name, op in (("greater", ">"), ("equal", "="), ("less", "<"), ("greater_equal", ">="), ("less_equal", "<="), ("not_equal", "<>")):
        SPECS[f"compare_{name}"] = Spec("part", f"=E1{op}E2", f"p_size {op} {lead('p_size', 1)}", "b")
    SPECS["ctl_if"] = Spec("lineitem", "=IF(E1>25,F1,G1)", "CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE l_discount END")
    SPECS["ctl_if_null"] = Spec("lineitem", "=IF(E1>25,NULL,G1)", "CASE WHEN l_quantity > 25 THEN NULL ELSE l_discount END")
    SPECS["ctl_if_nested"] = Spec("lineitem", "=IF(E1>25,F1,IF(E1<10,G1,H1))", "CASE WHEN l_quantity > 25 THEN l_extendedprice WHEN l_quantity < 10 THEN l_discount ELSE l_tax END")
    SPECS["ctl_if_aggregates"] = Spec("lineitem", "=IF(E1>25,SUM(E1:F2),AVERAGE(G1:H2))", f"CASE WHEN l_quantity > 25 THEN CASE WHEN row_id + 1 <= n THEN sum(l_quantity + l_extendedprice) {_frame('CURRENT ROW', _below(1))} END ELSE CASE WHEN row_id + 1 <= n THEN sum(l_discount + l_tax) {_frame('CURRENT ROW', _below(1))} / 4.0 END END")


def _lookups() -> None:
    within = "row_id <= 5000"
    first = f"LEFT JOIN (SELECT l_orderkey AS k, arg_min(l_quantity, row_id) AS q, min(row_id) AS r FROM b WHERE {within} GROUP BY 1) s ON s.k = b.l_partkey"
    SPECS["lookup_exact"] = Spec("lineitem", "=LOOKUP(B1,A$1:A$5000,E$1:E$5000,0)", "s.q", joins=first)
    asof = f"LEFT JOIN (SELECT p.k, t.l_quantity AS q FROM (SELECT k, (SELECT {{fn}}(row_id) FROM b WHERE {within} AND l_orderkey {{op}} k) AS r FROM (SELECT DISTINCT l_partkey AS k FROM b)) p JOIN b t ON t.row_id = p.r) s ON s.k = b.l_partkey"
    SPECS["lookup_approx_le"] = Spec("lineitem", "=LOOKUP(B1,A$1:A$5000,E$1:E$5000,1)", "s.q", joins=asof.format(fn="max", op="<="))
    SPECS["lookup_approx_ge"] = Spec("lineitem", "=LOOKUP(B1,A$1:A$5000,E$1:E$5000,-1)", "s.q", joins=asof.format(fn="min", op=">="))
    SPECS["lookup_in_if"] = Spec("lineitem", "=IF(E1>25,SUM(E1:F2),LOOKUP(B1,A$1:A$5000,E$1:E$5000,0))", f"CASE WHEN l_quantity > 25 THEN CASE WHEN row_id + 1 <= n THEN sum(l_quantity + l_extendedprice) {_frame('CURRENT ROW', _below(1))} END ELSE s.q END", joins=first)
    SPECS["index_fixed"] = Spec("lineitem", "=INDEX(E$1:E$5000,B1)", "t.l_quantity", joins="LEFT JOIN b t ON t.row_id = b.l_partkey + 1 AND t.row_id <= 5000")
    SPECS["index_moving"] = Spec("lineitem", "=INDEX(E2:F5,D1,1)", "t.l_extendedprice", joins="LEFT JOIN b t ON t.row_id = b.row_id + 1 + b.l_linenumber - 1 AND b.l_linenumber <= 4")
    SPECS["match_exact"] = Spec("lineitem", "=MATCH(B1,A$1:A$5000,0)", "s.r", "i", joins=first)
    SPECS["match_approx"] = Spec("lineitem", "=MATCH(B1,A$1:A$5000,1)", "s.r", "i", joins=f"LEFT JOIN (SELECT k, (SELECT max(row_id) FROM b WHERE {within} AND l_orderkey <= k) AS r FROM (SELECT DISTINCT l_partkey AS k FROM b)) s ON s.k = b.l_partkey")
    SPECS["vlookup_approx"] = Spec("lineitem", "=VLOOKUP(B1,A$1:F$5000,5,1)", "s.q", joins=asof.format(fn="max", op="<="))
    SPECS["vlookup_exact"] = Spec("lineitem", "=VLOOKUP(B1,A$1:F$5000,5,0)", "s.q", joins=first)
    SPECS["hlookup_exact"] = Spec("lineitem", "=HLOOKUP(D1,E$1:H$4,3)", "CASE l_linenumber WHEN (SELECT l_quantity FROM b WHERE row_id = 1) THEN (SELECT l_quantity FROM b WHERE row_id = 3) WHEN (SELECT l_extendedprice FROM b WHERE row_id = 1) THEN (SELECT l_extendedprice FROM b WHERE row_id = 3) WHEN (SELECT l_discount FROM b WHERE row_id = 1) THEN (SELECT l_discount FROM b WHERE row_id = 3) WHEN (SELECT l_tax FROM b WHERE row_id = 1) THEN (SELECT l_tax FROM b WHERE row_id = 3) END")
    # the same over the whole column
    first = first.replace(f" WHERE {within}", "")
    asof = "LEFT JOIN (SELECT p.k, t.l_quantity AS q, t.row_id AS r FROM (SELECT DISTINCT l_partkey AS k FROM b) p ASOF JOIN (SELECT l_orderkey AS o, {fn}({fn}(row_id)) OVER (ORDER BY l_orderkey {way}) AS r FROM b GROUP BY 1) v ON p.k {op} v.o JOIN b t ON t.row_id = v.r) s ON s.k = b.l_partkey"
    last_le, first_ge = asof.format(fn="max", way="ASC", op=">="), asof.format(fn="min", way="DESC", op="<=")
    index = SPECS["index_fixed"].joins.replace(" AND t.row_id <= 5000", "")
    for name, joins in {"lookup_exact": first, "lookup_approx_le": last_le, "lookup_approx_ge": first_ge, "lookup_in_if": first, "index_fixed": index, "match_exact": first, "match_approx": last_le, "vlookup_exact": first}.items():
        part = SPECS[name]
        SPECS[f"{name}_whole"] = Spec(part.table, part.formula.replace("$5000", "${n}"), part.sql, part.kind, joins=joins)
    for s in SPECS.values():
        if s.joins:
            for c in ("l_quantity", "l_extendedprice", "row_id"):
                s.sql = s.sql.replace(f"({c}", f"(b.{c}").replace(f" {c} ", f" b.{c} ").replace(f" {c})", f" b.{c})") if "sum(" in s.sql or c == "row_id" else s.sql


def _scalars() -> None:
    bal, size = "c_acctbal", "p_size"
    unit, big = f"({bal} / 10000)", f"({bal} / 100)"
    one = {
        "abs": ("D1", f"abs({bal})"), "acos": ("D1/10000", f"acos({unit})"), "acot": ("D1/100", f"CASE WHEN {big} = 0 THEN pi() / 2 ELSE atan(1 / {big}) END"),
        "acosh": ("D1/100", f"CASE WHEN {big} >= 1 THEN acosh({big}) END"), "acoth": ("D1/100", f"CASE WHEN abs({big}) > 1 THEN 0.5 * ln(({big} + 1) / ({big} - 1)) END"),
        "asin": ("D1/10000", f"asin({unit})"), "asinh": ("D1/100", f"asinh({big})"), "atan": ("D1/100", f"atan({big})"), "atanh": ("D1/10000", f"CASE WHEN abs({unit}) < 1 THEN atanh({unit}) END"),
        "cos": ("D1/100", f"cos({big})"), "cosh": ("D1/10000", f"cosh({unit})"), "cot": ("A1+1/7", "1 / tan((c_custkey + 1) / 7.0)"), "coth": ("A1+1/7", "1 / tanh((c_custkey + 1) / 7.0)"),
        "csc": ("A1+1/7", "1 / sin((c_custkey + 1) / 7.0)"), "csch": ("A1+1/70000", "2 / (exp((c_custkey + 1) / 70000.0) - exp(-(c_custkey + 1) / 70000.0))"), "degrees": ("D1/10000", f"degrees({unit})"),
        "even": ("D1", f"ceil({bal} / 2) * 2"), "exp": ("D1/10000", f"exp({unit})"), "int": ("D1", f"floor({bal})"), "ln": ("D1", f"CASE WHEN {bal} > 0 THEN ln({bal}) END"),
        "log10": ("D1", f"CASE WHEN {bal} > 0 THEN log10({bal}) END"), "odd": ("D1", f"floor(ceil({bal}) / 2) * 2 + 1"), "radians": ("D1", f"radians({bal})"), "sec": ("D1/100", f"1 / cos({big})"),
        "sech": ("D1/10000", f"1 / cosh({unit})"), "sin": ("D1/100", f"sin({big})"), "sinh": ("D1/10000", f"sinh({unit})"), "sqrt": ("D1", f"CASE WHEN {bal} >= 0 THEN sqrt({bal}) END"),
        "sqrtpi": ("D1", f"CASE WHEN {bal} >= 0 THEN sqrt(pi() * {bal}) END"), "tan": ("D1/10000", f"tan({unit})"), "tanh": ("D1/10000", f"tanh({unit})"),
    }
    for name, (arg, sql) in one.items():
        SPECS[f"math_{name}"] = Spec("customer", f"={name.upper()}({arg})", sql)
    SPECS["math_sign"] = Spec("customer", "=SIGN(D1)", f"sign({bal})", "i")
    SPECS["math_iseven"] = Spec("part", "=ISEVEN(E1)", f"{size} % 2 = 0", "b")
    SPECS["math_isodd"] = Spec("part", "=ISODD(E1)", f"{size} % 2 = 1", "b")
    SPECS["math_fact"] = Spec("lineitem", "=FACT(D1)", "factorial(l_linenumber)")
    SPECS["math_factdouble"] = Spec("lineitem", "=FACTDOUBLE(D1)", "list_product(range(CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END, l_linenumber + 1, 2))")
    SPECS["math_roman"] = Spec("part", "=ROMAN(E1)", f"['', 'X', 'XX', 'XXX', 'XL', 'L'][{size} // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][{size} % 10 + 1]", "t")
    SPECS["math_arabic"] = Spec("part", "=ARABIC(ROMAN(E1))", size)
    two = {
        "atan2": ("D1,A1", f"atan2({bal}, c_custkey)"), "mod": ("D1,-7", f"{bal} - (-7) * floor({bal} / -7)"), "mround": ("D1,3", f"3 * round_even({bal} / 3, 0)"), "power": ("A1,0.5", "pow(c_custkey, 0.5)"),
        "ceiling": ("D1,10", f"ceil({bal} / 10) * 10"), "ceiling.math": ("D1,10,1", f"sign({bal}) * ceil(abs({bal}) / 10) * 10"), "ceiling.precise": ("D1,-10", f"ceil({bal} / 10) * 10"), "iso.ceiling": ("D1", f"ceil({bal})"),
        "floor": ("D1,10", f"floor({bal} / 10) * 10"), "floor.math": ("D1,10,1", f"sign({bal}) * floor(abs({bal}) / 10) * 10"), "floor.precise": ("D1,-10", f"floor({bal} / 10) * 10"),
        "round": ("D1,1", f"round_even({bal} * 10, 0) / 10"), "rounddown": ("D1,1", f"floor({bal} * 10) / 10"), "roundup": ("D1,1", f"ceil({bal} * 10) / 10"), "trunc": ("D1", f"trunc({bal})"),
    }
    for name, (args, sql) in two.items():
        SPECS[f"math_{name.replace('.', '_')}"] = Spec("customer", f"={name.upper()}({args})", sql)
    SPECS["math_decimal"] = Spec("part", "=DECIMAL(E1,16)", f"({size} // 10) * 16 + {size} % 10")
    SPECS["math_randbetween"] = Spec("part", "=RANDBETWEEN(1,E1+2)", None)
    texts = {
        "concat": ('B1,"-",C1', "p_name || '-' || p_brand", "t"), "concatenate": ('B1,"-",C1,E1', "p_name || '-' || p_brand || CAST(p_size AS VARCHAR)", "t"), "exact": ('C1,"Brand#13"', "p_brand = 'Brand#13'", "b"),
        "find": ('"a",B1', "strpos(p_name, 'a') - 1", "i"), "left": ("B1,3", "left(p_name, 3)", "t"), "len": ("B1", "length(p_name)", "i"), "lower": ("C1", "lower(p_brand)", "t"), "mid": ("B1,2,3", "substr(p_name, 3, 3)", "t"),
        "replace": ('B1,1,2,"XY"', "substr(p_name, 1, 1) || 'XY' || substr(p_name, 4)", "t"), "right": ("B1,4", "right(p_name, 4)", "t"), "trim": ('CONCAT("  ",B1,"  ")', "p_name", "t"), "upper": ("D1", "upper(p_type)", "t"),
        "value": ('CONCAT(E1,"%")', "p_size / 100.0", "d"),
    }
    for name, (args, sql, kind) in texts.items():
        SPECS[f"text_{name}"] = Spec("part", f"={name.upper()}({args})", sql, kind)
    SPECS["text_value_time"] = Spec("part", '=VALUE(CONCAT(MOD(E1,12),":",RIGHT(CONCAT("0",MOD(E1,60)),2),":30 PM"))', "((p_size % 12 + 12) * 3600 + (p_size % 60) * 60 + 30) / 86400.0")
    SPECS["text_value_percent"] = Spec("part", '=VALUE(CONCAT(E1,".5%"))', "(p_size + 0.5) / 100")
    SPECS["text_value_date"] = Spec("part", '=VALUE(CONCAT("2001-09-",RIGHT(CONCAT("0",MOD(E1,28)+1),2)))', "date_diff('day', DATE '1899-12-30', DATE '2001-09-01') + p_size % 28")


_lookups()
_aggregates()
_arithmetic()
_scalars()


def sheet(spark: SparkSession, sf_dir: str, table: str, **options) -> Sheet:
    return Sheet.from_dataframe(spark.read.parquet(f"{sf_dir}/{table}.parquet"), KEYS[table], **options)


def _query(spec: Spec) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = sheet(spark, sf_dir, spec.table, **spec.options)
        out = cells.compute(spec.formula.replace("{n}", str(cells.rows)) if "{n}" in spec.formula else spec.formula)
        return out.select("row_id", _CASTS[spec.kind](F.col("value")).alias("value"))

    return run


def _sql(spec: Spec) -> str:
    keys = ", ".join(KEYS[spec.table])
    value = _SQL_CASTS[spec.kind].format(f"({spec.sql})")
    return f"WITH b AS (SELECT *, row_number() OVER (ORDER BY {keys}) AS row_id, count(*) OVER () AS n FROM {spec.table}) SELECT b.row_id, {value} AS value FROM b {spec.joins}"


def sheet_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows with lettered columns: a report of ten rows."""
    return sheet(spark, sf_dir, "supplier").head(10, names=False)


def stream_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula over the row's own cells, as it runs on a streaming frame."""
    from gridcalc.streaming import with_formula

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    return with_formula(rows, "=ROUND(B1*2,1)+1", name="result").select("event_id", F.round("result", 4).alias("value"))


FLAGSHIP = "ctl_if_aggregates"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(spec) for name, spec in SPECS.items()} | {"sheet_head": sheet_head, "stream_formula": stream_formula}
ORACLES: dict[str, str] = {name: _sql(spec) for name, spec in SPECS.items() if spec.sql is not None}
ORACLES["stream_formula"] = "SELECT event_id, round(round(value * 2, 1) + 1, 4) AS value FROM events"
ORACLES["sheet_head"] = "SELECT row_number() OVER (ORDER BY s_suppkey) AS row_id, s_suppkey AS A, s_name AS B, s_nationkey AS C, s_acctbal AS D FROM supplier ORDER BY s_suppkey LIMIT 10"
