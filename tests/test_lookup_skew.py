from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridcalc import Sheet
from gridcalc.operators import lookups

ROWS = 110_000


def source(k):
    """What a row asks for: mostly nothing that is there, then one key, now and then one of its own."""
    return k if k % 10 == 0 else 7 if k % 10 < 4 else ROWS * 2


@pytest.fixture(scope="module")
def cells(spark):
    own = F.when(F.col("a") % 10 == 0, F.col("a")).when(F.col("a") % 10 < 4, 7).otherwise(ROWS * 2)
    df = spark.range(ROWS).select(F.col("id").alias("a"), own.alias("b"), (F.col("id") * 3).alias("c"), F.concat(F.lit("t"), "id").alias("d"), F.concat(F.lit("t"), own.cast("string")).alias("e"))
    return Sheet.from_dataframe(df, ["a"])


def index(last, text=False):
    return lambda k: (f"t{source(k)}" if text else source(k) * 3) if source(k) < last else None


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("=INDEX(C$1:C$5000,B1)", index(5000)), ("=INDEX(C$1:C$110000,B1)", index(ROWS)), ("=INDEX(D$1:D$5000,B1)", index(5000, True)),
        ("=LOOKUP(B1,A$1:A$4000,C$1:C$4000,0)", index(4000)), ("=LOOKUP(B1,A$2:A$110000,C$1:C$109999,0)", lambda k: (source(k) - 1) * 3 if 0 < source(k) < ROWS else None),
        ("=LOOKUP(E1,D$1:D$110000,C$1:C$110000,0)", index(ROWS)), ("=MATCH(B1,A$1:A$110000,1)", lambda k: min(source(k) + 1, ROWS)), ("=MATCH(7,A$1:A$110000,0)", lambda k: 8),
    ],
)
def test_no_task_gathers_the_rows_that_ask_for_the_same_or_for_nothing(spark, cells, monkeypatch, formula, want):
    for name, value in {"BROADCAST_ROWS": 5000, "HOT_ROWS": 5000, "HOT_PARTS": 100}.items():
        monkeypatch.setattr(lookups, name, value, raising=False)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = cells.compute(formula).withColumn("part", F.spark_partition_id()).toArrow().to_pydict()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = dict(zip(found["row_id"], found["value"], strict=True))
    most = max(Counter(found["part"]).values())
    assert len(found["row_id"]) == len(got) == ROWS
    wrong = [(k, v, want(k - 1)) for k, v in got.items() if v != want(k - 1)]
    assert not wrong, (len(wrong), wrong[:3])
    assert most < ROWS / 6, most


@pytest.mark.parametrize("key", ["CAST(NULL AS STRING)", "IF(id % 2 = 0, -0.0D, 0.0D)", "IF(id % 2 = 0, double('nan'), 0.0D)", "id % 3", "IF(id % 2 = 0, 'x', 'X') COLLATE UTF8_LCASE", "IF(id % 2 = 0, TIMESTAMP'2020-10-25 01:30:00', NULL)"])
def test_hot_keys_of_every_kind_keep_their_hits(spark, monkeypatch, key):
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lookups, "HOT_ROWS", 1000)
    monkeypatch.setattr(lookups, "RANGE_ROWS", 3000)
    df = spark.range(20_000).selectExpr("id + 1 AS __row", "id", f"{key} AS asked")
    hits = lookups.exact(df.selectExpr("asked AS key", "__row AS row", "id AS target"))
    plain = {r.asked: r.first for r in df.where("asked IS NOT NULL").groupBy("asked").agg(F.min("__row").alias("first")).collect()}
    out = lookups.join_key(df, F.col("asked"), hits, "hit", 20_000, 20_000)
    assert set(out.columns) == {*df.columns, "hit"}
    got = out.groupBy("asked", "hit.row").count().collect()
    assert sum(r["count"] for r in got) == 20_000
    for r in got:
        assert r.row is None if r.asked is None else r.row in plain.values()
    assert {r.row for r in got} - {None} == set(plain.values())
