"""Sources of sheets, and dense row numbers in the order of a key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcalc.errors import SheetConfigError
from gridcalc.operators.frames import ROW

#: Tables up to this size are numbered by one ordered window; rows of one range of larger ones, about.
ONE_TASK_ROWS = 100_000
RANGE_ROWS = 1_000_000


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = False) -> DataFrame:
    reader = spark.read.option("header", header)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, user: str, password: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table over JDBC, read in ranges of ``partition_column`` where it is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, user=user, password=password, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def read_formulas(path: str, delimiter: str = "|") -> list[str]:
    """Formulas of a list, one a line; what follows the delimiter is left out."""
    with open(path, encoding="utf-8") as lines:
        return [f for f in (line.split(delimiter)[0].strip() for line in lines) if f]


def write_result(result: DataFrame, path: str, mode: str = "errorifexists") -> None:
    result.write.mode(mode).parquet(path)


def check_key(df: DataFrame, columns: list[str]) -> None:
    """Raises where a key's columns are missing, null or not unique."""
    known = {c.lower() for c in df.columns}
    if missing := [c for c in columns if c.lower() not in known]:
        raise SheetConfigError(f"no such column: {', '.join(missing)}")
    if df.groupBy(*columns).count().where("count > 1").take(1):
        raise SheetConfigError(f"not unique: {', '.join(columns)}")
    if df.where(" or ".join(f"`{c}` is null" for c in columns)).take(1):
        raise SheetConfigError(f"null in: {', '.join(columns)}")


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise SheetConfigError("numbering a large table takes a folder that driver and executors share: set spark.checkpoint.dir")
        root = "file://" + tempfile.mkdtemp(prefix="gridcalc-rows-")
    path = f"{root.rstrip('/')}/gridcalc/rows-{uuid.uuid4().hex}"
    file_system, jvm_path = _file_system(spark, path)
    file_system.deleteOnExit(jvm_path)
    return path


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def delete(spark: SparkSession, path: str) -> None:
    file_system, jvm_path = _file_system(spark, path)
    file_system.delete(jvm_path, True)


def _hashed(df: DataFrame) -> list[Column]:
    """What orders rows of equal keys: a hash of all that can be hashed; rows that agree in it have the same cells."""
    fine = [c for c, f in zip(df.columns, df.schema.fields, strict=True) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return [F.xxhash64(*(F.col(f"`{c}`") for c in fine))] if fine and len({c.lower() for c in df.columns}) == len(df.columns) else []


def number_rows(df: DataFrame, order_by: list[str], rows: int, one_task_rows: int = ONE_TASK_ROWS) -> tuple[DataFrame, str | None]:
    """Adds the column ROW, 1 to n in the order of ``order_by``; also gives the folder of what was written for it.

    A large table is dealt out by ranges of the key, sorted within them and written with each row's place; the ranges'
    sizes, one number a partition, give the places' offsets.
    """
    order = [*map(F.col, order_by), *_hashed(df)]
    if rows <= one_task_rows:
        return df.withColumn(ROW, F.row_number().over(Window.orderBy(*order)).cast("long")), None
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("__place", place).select("*", F.shiftright("__place", 33).alias("__part"), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)).alias("__in")).drop("__place")
    path = _folder(spark)
    ranged.write.parquet(path)
    table = spark.read.schema(ranged.schema).parquet(path)
    offsets, total = {}, 0
    for r in sorted(table.groupBy("__part").count().collect()):  # one row a partition
        offsets[r["__part"]], total = total, total + r["count"]
    start = spark.createDataFrame(list(offsets.items()), "__part long, __start long")
    return table.join(F.broadcast(start), "__part").withColumn(ROW, F.col("__start") + F.col("__in") + 1).drop("__part", "__in", "__start"), path
