import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcalc import Sheet, register
from gridcalc.errors import FormulaNotSupported, FunctionNotSupported, SheetConfigError
from gridcalc.operators import frames, lookups, medians
from gridcalc.sources import tables
from gridcalc.streaming import with_formula


class Keyed:
    """A sheet whose order key is not one of its lettered columns' concern: the key is the last column."""

    def __init__(self, spark, rows, types, **options):
        schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)] + [T.StructField("key", T.LongType())])
        df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], schema)
        self.sheet = Sheet.from_dataframe(df, ["key"], **options)

    def __call__(self, formula, **options):
        return [r.value for r in self.sheet.compute(formula, **options).orderBy("row_id").collect()]


D, L, S = T.DoubleType(), T.LongType(), T.StringType()


@pytest.fixture(scope="module")
def ones(spark):
    return Keyed(spark, [(1.0,) * 5] * 100, [D] * 5)


@pytest.fixture(scope="module")
def arange(spark):
    return Keyed(spark, [tuple(range(5 * i, 5 * i + 5)) for i in range(100)], [L] * 5)


@pytest.fixture(scope="module")
def four(spark):
    return Keyed(spark, [(1, 2, 2, 3), (2, 2, 3, 2), (3, 2, 4, 2), (4, 2, 5, 3)], [L] * 4, boundary="clip", sumif_empty="null")


@pytest.mark.parametrize("formula,value", [
    ("=SUM(A1:B3)", 6), ("=SUM(A1:B3,10)", 16), ("=MIN(A1:B3,A$1,A1:A$100,3)", 1), ("=AVERAGE(A1:B3,A$1,A1:A$100,A$1:A1,1,1,1)", 1), ("=COUNT(A1:B3,B1:B2)", 8), ("=A$1/B3", 1),
])
def test_ones(ones, formula, value):
    assert ones(formula) == [value] * 98 + [None] * 2


@pytest.mark.parametrize("formula,head,last", [
    ("=MEDIAN(A1:C3)", [6, 11], None), ("=MEDIAN(A$1:C$3)", [6, 6], 6), ("=MEDIAN(A1:C$100)", [248.5, 251], 496), ("=MEDIAN(A$1:C3)", [6, 8.5], None), ('=SUMIF(A$10:C$12,">50")', [271, 271], 271),
    ("=SUM(A$1:A1)", [0, 5], 24750), ("=SUM(A1:A$100)", [24750, 24750], 495), ("=COUNT(A5:A$7)", [3, 2], 0), ("=MAX(A5:A$7)", [30, 30], None), ('=AVERAGEIF(A1:B2,">7")', [None, 10.5], None), ('=COUNTIF(A1:E1,"<=12")', [5, 5], 0), ('=MAXIF(A1:E1,"<3")', [2, None], None), ('=MINIF(A1:E1,"<>0")', [1, 5], 495),
])
def test_arange(arange, formula, head, last):
    got = arange(formula)
    assert got[:2] == head
    assert got[-1] == last


FOUR = {
    "=SUM(B1:C2)": [9, 11, 13, 7], "=SUM(B$1:C1)": [4, 9, 15, 22], '=SUMIF(C1:C2,">2")': [3, 7, 9, 5], '=SUMIF(A1:A1,">9")': [None] * 4, "=LOOKUP(D1,B$1:B$4,C$1:C$4,0)": [None, 2, 2, None], "=LOOKUP(D1,B$1:B$4,C$1:C$4,1)": [5, 5, 5, 5],
    "=LOOKUP(B1,C$1:C$4,D$1:D$4,-1)": [3, 3, 3, 3], "=INDEX(D$1:D$4,A1)": [2, 2, 3, None], "=A1+INDEX(D$1:D$4,A1)": [3, 4, 6, None], "=SUM(A1:A2,C1:C2)": [8, 12, 16, 9], "=SUM(A1:A2,B1,C1:C2)": [10, 14, 18, 11], "=A1-B1+C2": [2, 4, 6, None],
    "=INDEX(C1:D2,B1,1)": [2, 2, 3, None], "=SUM(A1:C$4)": [32, 27, 20, 11], "=MAX(C$2:C2)": [3, 4, 5, 5], "=SUM(C2:C$3)": [7, 4, None, None], "=A1+B1*C1": [6, 12, 20, 30], "=-A1+B1": [-3, -4, -5, -6], "=1+2": [3] * 4, "=A1": [1, 2, 3, 4],
    "=A3": [3, 4, None, None], "=A$2*B$3": [4] * 4, "=MATCH(D1,C$1:C$4,0)": [2, 1, 1, 2], "=VLOOKUP(D1,A$1:C$4,3,0)": [4, 3, 3, 4], "=HLOOKUP(D1,A$1:D$2,2)": [2, 2, 2, 2], "=IF(A1>2,SUM(A1:B2),AVERAGE(C1:D2))": [2.5, 2.75, 11, 6], "=A1/0": [None] * 4, "=SUM(A1+B1,C1:C2)": [8, 11, 14, 11],
    "=LOOKUP(D1,B$2:B$4,C$1:C$3,0)": [None, 2, 2, None], "=SUM(A$1:A3)": [6, 10, 10, 10], "=IF(D1=3,NULL,A1)": [None, 2, 3, None],
}


@pytest.mark.parametrize("bucket", [65_536, 2])
@pytest.mark.parametrize("formula", FOUR)
def test_four(four, monkeypatch, bucket, formula):
    monkeypatch.setattr(frames, "LEAST_BUCKET", bucket)
    assert four(formula) == FOUR[formula]


def reference(rows, kind, a, b, boundary, fn):
    """Per row, from the definition: fn over the non-null cells of rows a..b, moving or fixed as kind says."""
    n, out = len(rows), []
    for i in range(n):
        low, high = a + (i if kind[0] == "R" else 0), b + (i if kind[1] == "R" else 0)
        if boundary == "null" and kind[1] == "R" and high >= n and b:
            out.append(None)
            continue
        cells = [x for r in range(low, min(high, n - 1) + 1) for x in [rows[r]]]
        seen = [x for x in cells if x is not None]
        if fn == "COUNT":
            out.append(len(seen))
        elif not cells:
            out.append(None)
        elif fn == "SUM":
            out.append(sum(seen))
        else:
            out.append((max if fn == "MAX" else min)(seen) if seen else None)
    return out


@pytest.mark.parametrize("boundary", ["null", "clip"])
@pytest.mark.parametrize("kind,ref,a,b", [("RR", "A1:A4", 0, 3), ("RR", "A3:A5", 2, 4), ("FR", "A$3:A2", 2, 1), ("FR", "A$1:A1", 0, 0), ("RF", "A3:A$9", 2, 8), ("FF", "A$2:A$6", 1, 5)])
def test_strategies_equal_definition_with_nulls(spark, monkeypatch, boundary, kind, ref, a, b):
    values = [None, None, 3, 1, None, 7, 2, 9, None, 4, 4, None, None]
    sheet = Keyed(spark, [(v,) for v in values], [L], boundary=boundary)
    for bucket in (65_536, 3):
        monkeypatch.setattr(frames, "LEAST_BUCKET", bucket)
        for fn in ("SUM", "COUNT", "MAX", "MIN"):
            assert sheet(f"={fn}({ref})") == reference(values, kind, a, b, boundary, fn), (fn, bucket)


def test_window_longer_than_sheet_one_row_and_empty(spark):
    few = Keyed(spark, [(1,), (2,)], [L], boundary="clip")
    assert few("=SUM(A1:A2)") == [3, 2]
    assert Keyed(spark, [(5,)], [L])("=SUM(A1,A1:A1)") == [10]
    empty = Keyed(spark, [], [L])
    assert empty("=A1+1") == []
    assert empty("=SUM(A$1:A1)") == []


MIXED = [("A", 1, "A", 1, -1, 0, 0.37, 0, "II", math.pi / 2, 2, 16), ("B", 1, "B", 2, 2, 0, 1.58, 35, "VII", math.pi / 2, 2, 16), ("C", 1, "C", 3, -3, 0, 2.91, 55, "XIV", math.pi / 2, 2, 16), ("D", 1, "D", 4, 4, 0, 3.97, 85, "CD", math.pi / 2, 2, 16)]


@pytest.fixture(scope="module")
def mixed(spark):
    return Keyed(spark, MIXED, [S, L, S, L, L, L, D, L, S, D, L, L])


@pytest.mark.parametrize("formula,want", [
    ("=ABS(E1)", [1, 2, 3, 4]), ("=ARABIC(I1)", [2, 7, 14, 400]), ("=ACOT(B1)", [math.pi / 4] * 4), ("=ACOTH(K1)", [math.atanh(0.5)] * 4), ("=ACOS(K1)", [None] * 4), ("=EVEN(D1)", [2, 2, 4, 4]), ("=ODD(D1)", [1, 3, 3, 5]),
    ("=FACT(D1)", [1, 2, 6, 24]), ("=FACTDOUBLE(D1)", [1, 2, 3, 8]), ("=FACT(L1)", [math.factorial(16)] * 4), ("=ISEVEN(D1)", [False, True, False, True]), ("=ISODD(E1)", [True, False, True, False]), ("=SIGN(E1)", [-1, 1, -1, 1]),
    ("=LN(F1)", [None] * 4), ("=SQRT(E1)", [None, 2**0.5, None, 2]), ("=ATANH(B1)", [None] * 4), ("=ATAN2(B1,K1)", [math.atan2(1, 2)] * 4), ("=DECIMAL(L1,16)", [22] * 4), ("=DECIMAL(\"1G\",16)", [None] * 4), ("=DECIMAL(\"zz\",36)", [1295] * 4),
    ("=MOD(E1,-3)", [-1, -1, 0, -2]), ("=MROUND(H1,20)", [0, 40, 60, 80]), ("=POWER(D1,2)", [1, 4, 9, 16]), ("=CEILING(G1)", [1, 2, 3, 4]), ("=CEILING.MATH(E1,2,1)", [-2, 2, -4, 4]), ("=CEILING.PRECISE(E1,-2)", [0, 2, -2, 4]), ("=ISO.CEILING(G1)", [1, 2, 3, 4]),
    ("=FLOOR(G1)", [0, 1, 2, 3]), ("=FLOOR.MATH(E1,2,1)", [0, 2, -2, 4]), ("=FLOOR.PRECISE(E1,-2)", [-2, 2, -4, 4]), ("=ROMAN(H1)", ["N", "XXXV", "LV", "LXXXV"]), ("=ROUND(G1,1)", [0.4, 1.6, 2.9, 4]), ("=ROUND(2.5)", [2] * 4),
    ("=ROUNDDOWN(E1/2)", [-1, 1, -2, 2]), ("=ROUNDUP(G1,1)", [0.4, 1.6, 3, 4]), ("=TRUNC(E1/2)", [0, 1, -1, 2]), ("=SEC(F1)", [1] * 4), ("=CSC(J1)", [1] * 4), ("=COT(F1)", [None] * 4), ("=SQRTPI(B1)", [math.sqrt(math.pi)] * 4), ("=D1^K1", [1, 4, 9, 16]), ("=D1%", [0.01, 0.02, 0.03, 0.04]),
    ("=A1&D1", ["A1", "B2", "C3", "D4"]), ("=EXACT(A1,\"A\")", [True, False, False, False]), ("=A1=C1", [True] * 4), ("=D1>=3", [False, False, True, True]), ("=A1+C1", ["AA", "BB", "CC", "DD"]),
])
def test_scalars(mixed, formula, want):
    got = mixed(formula)
    assert all(g == w or isinstance(w, (int, float)) and g is not None and math.isclose(g, w, abs_tol=1e-9) for g, w in zip(got, want, strict=True)), got


def test_random_between_excludes_the_end(mixed):
    assert set(mixed("=RANDBETWEEN(3,5)")) <= {3.0, 4.0}


@pytest.fixture(scope="module")
def text(spark):
    return Keyed(spark, [("  GrId Line  ", "2:45:12 PM", "31.25%", "March 15, 2004", "héé ñ", None)], [S] * 6)


@pytest.mark.parametrize("formula,want", [
    ('=CONCAT(A1,"x",1)', "  GrId Line  x1"), ('=CONCATENATE("x",E1)', "xhéé ñ"), ('=FIND("L",A1)', 7), ('=FIND("L",A1,8)', -1), ("=LEFT(A1)", " "), ("=LEFT(A1,4)", "  Gr"), ("=LEN(E1)", 5), ("=LOWER(A1)", "  grid line  "), ("=MID(A1,2,4)", "GrId"),
    ('=REPLACE(A1,2,4,"Best")', "  Best Line  "), ("=RIGHT(A1,3)", "e  "), ("=RIGHT(E1,99)", "héé ñ"), ("=TRIM(A1)", "GrId Line"), ("=UPPER(E1)", "HÉÉ Ñ"), ("=VALUE(B1)", 14 / 24 + 45 / 1440 + 12 / 86400), ("=VALUE(C1)", 0.3125), ("=VALUE(D1)", 38061),
    ('=VALUE("2004-03-15")', 38061), ('=VALUE("3/15/2004")', 38061), ('=VALUE("$1,234.5")', 1234.5), ('=VALUE("no")', None), ("=LEN(F1)", None), ('=EXACT(F1,"x")', False), ('=VALUE("2004-99-99")', None), ('=MID(E1,9,2)', ""),
])
def test_text(text, formula, want):
    got = text(formula)[0]
    assert got == want or want is not None and got is not None and math.isclose(got, want, abs_tol=1e-9)


def test_options_and_surface(spark, four, capsys):
    sheet = four.sheet
    assert [r.value for r in sheet.compute("=A1", num_formulas=2).collect()] == [1, 2]
    assert sheet.compute("=NOSUCH(A1)", safe=True) is None
    with pytest.raises(FunctionNotSupported):
        sheet.compute("=NOSUCH(A1)")
    assert sheet.head(2, names=False).columns == ["row_id", "A", "B", "C", "D", "E"]
    assert sheet.head(2).columns[1] == "A (c0)"
    sheet.show(1)
    sheet.explain("=SUM(A1:B2)", "simple")
    assert "Window" in capsys.readouterr().out
    sheet.compute("=A1")
    assert sheet.metrics()["total_s"] > 0
    sheet.reset_metrics()
    assert sheet.metrics() == {}
    both = sheet.compute_columns({"x": "=A1+1", "y": "=SUM(A1:A2)"})
    assert sorted(tuple(r) for r in both.collect())[0] == (1, 2, 3)
    register("TWICE", 1, 1, "n", "num", lambda x: x * 2)
    assert four("=TWICE(A1)") == [2, 4, 6, 8]
    sheet.close()


def test_sources(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("3,c\n1,a\n2,b\n")
    df = tables.read_csv(spark, str(path), "x long, y string")
    assert [r.value for r in Sheet.from_dataframe(df, ["x"]).compute("=B1").orderBy("row_id").collect()] == ["a", "b", "c"]
    df.createOrReplaceTempView("grid_t")
    sheet = Sheet.from_table(spark, "grid_t", ["x"])
    assert (sheet.options.boundary, sheet.options.sumif_empty) == ("clip", "null")
    import pandas as pd

    assert Sheet.from_dataframe(pd.DataFrame({"a": [1.5], "A": [2.5]}), ["a"], spark=spark).rows == 1 if not spark.conf.get("spark.sql.caseSensitive") == "true" else True
    with pytest.raises(SheetConfigError):
        Sheet.from_dataframe(df, ["nope"])
    with pytest.raises(SheetConfigError):
        tables.check_key(df.union(df), ["x"])
    formulas = tmp_path / "f.csv"
    formulas.write_text("=SUM(A1:A2)|x\n\n=A1\n")
    assert tables.read_formulas(str(formulas)) == ["=SUM(A1:A2)", "=A1"]
    tables.write_result(sheet.compute("=A1"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_dense_numbers_of_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(1).alias("v"))
    numbered, folder = tables.number_rows(df, ["k"], 1000, one_task_rows=100)
    got = numbered.select("k", frames.ROW).collect()
    assert sorted((r[0], r[1]) for r in got) == [(i, i + 1) for i in range(1000)]
    assert os.path.exists(folder.removeprefix("file://"))
    tables.delete(spark, folder)
    assert not os.path.exists(folder.removeprefix("file://"))


def test_rows_of_equal_keys_have_one_order(spark):
    df = spark.createDataFrame([(1, i * 7 % 50) for i in range(50)], "k long, v long")
    order = [[r.v for r in tables.number_rows(x, ["k"], 50)[0].orderBy(frames.ROW).collect()] for x in (df, df.repartition(5, "v"))]
    assert order[0] == order[1]


@pytest.mark.parametrize("formula", ["=MEDIAN(A$3:A1)", "=MEDIAN(A1:B$250)", "=MEDIAN(A$1:B2)"])
@pytest.mark.parametrize("boundary", ["null", "clip"])
def test_running_median_over_ranges_and_buckets(spark, monkeypatch, formula, boundary):
    """Few cells a range, frequent values, nulls, askers in several stretches."""
    for name, n in (("RANGE_CELLS", 60), ("BUCKET_ROWS", 32), ("STRETCH", 70)):
        monkeypatch.setattr(medians, name, n)
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.1 else float(rng.choice([5, 5, 5, rng.randrange(40)])), rng.random() * 20 if k > 4 else None) for k in range(300)]
    got = Keyed(spark, rows, [D, D], boundary=boundary)(formula)

    def want(k):
        if formula == "=MEDIAN(A1:B$250)":
            cells = [x for r in rows[k:250] for x in r]
        else:
            end = k + 1 if formula == "=MEDIAN(A$3:A1)" else k + 2
            if end > len(rows) and boundary == "null":
                return None
            cells = [r[0] for r in rows[2:end]] if formula == "=MEDIAN(A$3:A1)" else [x for r in rows[:end] for x in r]
        cells = [x for x in cells if x is not None]
        return statistics.median(cells) if cells else None

    assert got == [want(k) for k in range(300)]


def test_lookup_over_ranges_of_numbers_and_texts(spark, monkeypatch):
    monkeypatch.setattr(lookups, "RANGE_ROWS", 20)
    rng = random.Random(2)
    rows = [(float(rng.randrange(90)), f"t{rng.randrange(90):02d}", float(k)) for k in range(200)]
    sheet = Keyed(spark, rows, [D, S, D])
    for c, letter in ((0, "A"), (1, "B")):
        for mode, at in ((1, lambda r, s: max((k for k, x in enumerate(rows) if x[r] <= s), default=None)), (-1, lambda r, s: min((k for k, x in enumerate(rows) if x[r] >= s), default=None))):
            got = sheet(f"=LOOKUP({letter}1,{letter}$1:{letter}$200,C$1:C$200,{mode})")
            assert got == [None if (k := at(c, x[c])) is None else rows[k][2] for x in rows]


def test_jdbc_round_trip(spark, tmp_path):
    """Over the database that comes with Spark."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame([(k, k * 1.5, f"n{k}") for k in range(1, 41)], "id long, price double, name string").write.format("jdbc").options(url=url, dbtable="items", user="u", password="p", **options).save()
    read = options | {"partition_column": "id", "bounds": (1, 41), "partitions": 3}
    sheet = Sheet.from_jdbc(spark, url, "items", "u", "p", key=["id"], read=read, check_keys=True)
    assert sheet.source.rdd.getNumPartitions() == 3
    got = [r.value for r in sheet.compute("=SUM(B1:B2)").orderBy("row_id").collect()]
    assert got == [1.5 * k + 1.5 * (k + 1) for k in range(1, 40)] + [60.0]
    with pytest.raises(SheetConfigError):
        Sheet.from_jdbc(spark, url, "items", "u", "p", key=["nope"], read=read)


def test_key_is_checked_beside_another_order(spark):
    spark.createDataFrame([(1, 3), (1, 2)], "k long, o long").createOrReplaceTempView("keyed")
    assert Sheet.from_table(spark, "keyed", key=["k"], order_by=["o"]).rows == 2
    with pytest.raises(SheetConfigError):
        Sheet.from_table(spark, "keyed", key=["k"], order_by=["o"], check_keys=True)


def test_view_and_several_formulas_of_one_sheet(spark):
    sheet = Sheet.from_dataframe(spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 5.0)], "k long, v double"), ["k"]).persist()
    sheet.create_view("own_sheet")
    assert [tuple(r) for r in spark.sql("select row_id, A, B from own_sheet order by row_id").collect()] == [(1, 1, 2.0), (2, 2, 3.0), (3, 3, 5.0)]
    got = sheet.compute_columns({"s": "=SUM(B$1:B1)", "m": "=MAX(B1:B2)"}).orderBy("row_id").collect()
    assert [(r.s, r.m) for r in got] == [(2.0, 3.0), (5.0, 5.0), (10.0, None)]
    sheet.close()


def test_no_single_partition_exchange_in_frames(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("k"), (F.col("id") + 1).alias(frames.ROW))
    wanted = frames.Requests([frames.Moving("m", 0, 2, lambda w: F.sum("k").over(w))], [])
    plan = frames.apply(df, 1000, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_stream_of_own_row_formulas(spark, tmp_path):
    spark.range(5).selectExpr("id", "cast(id as double) as x").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, x double").parquet(str(tmp_path / "in"))
    query = with_formula(stream, "=ROUND(B1*2)+1").writeStream.format("memory").queryName("grid_stream").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.value for r in spark.table("grid_stream").collect()) == [1, 3, 5, 7, 9]
    with pytest.raises(FormulaNotSupported):
        with_formula(stream, "=SUM(A1:A2)")
