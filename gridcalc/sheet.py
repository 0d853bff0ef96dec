"""A table as a sheet: rows numbered from 1 in the order of a key, columns lettered, formulas filled down every row."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcalc.errors import GridError, SheetConfigError
from gridcalc.operators.frames import ROW
from gridcalc.plans.analyze import check
from gridcalc.plans.compile import Compiler, Options, cell
from gridcalc.plans.parser import parse
from gridcalc.plans.tree import column_letters
from gridcalc.sources.tables import check_key, delete, number_rows, read_jdbc


class Sheet:
    """``compute`` gives a lazy DataFrame (row_id, value), one row for each row of the sheet."""

    def __init__(self, df: DataFrame, order_by: Sequence[str], options: Options | None = None, precedence: str = "flat", check_keys: bool = False, key: Sequence[str] | None = None):
        if not order_by:
            raise SheetConfigError("a sheet needs the columns that order its rows")
        known = {c.lower() for c in df.columns}
        if missing := [c for c in [*order_by, *(key or ())] if c.lower() not in known]:
            raise SheetConfigError(f"no such column: {', '.join(missing)}")
        if check_keys:
            check_key(df, list(key or order_by))
        self.source, self.order_by, self.options, self.precedence = df, list(order_by), options or Options(), precedence
        self.names, self.types = df.columns, [f.dataType for f in df.schema.fields]
        self._rows: int | None = None
        self._numbered: DataFrame | None = None
        self._folder: str | None = None
        self._metrics: dict[str, float] = {}

    @classmethod
    def from_dataframe(cls, df, order_by: Sequence[str], spark: SparkSession | None = None, **options) -> Sheet:
        """A Spark frame, or a pandas frame with ``spark``. Windows past the bottom are null."""
        if not isinstance(df, DataFrame) and hasattr(df, "to_dict"):
            if spark is None:
                raise SheetConfigError("a pandas frame needs a session")
            df = spark.createDataFrame(df)
        return cls._with(df, order_by, {"boundary": "null", "sumif_empty": "zero"} | options)

    @classmethod
    def from_table(cls, spark: SparkSession, table: str, key: Sequence[str], order_by: Sequence[str] | None = None, **options) -> Sheet:
        """A table of the catalogue. Windows past the bottom are clipped, SUMIF without a match is null."""
        return cls._with(spark.table(table), order_by or key, {"key": key, "boundary": "clip", "sumif_empty": "null"} | options)

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, table: str, user: str, password: str, order_by: Sequence[str] | None = None, key: Sequence[str] | None = None, read: dict | None = None, **options) -> Sheet:
        """A table over JDBC, in the order of its key unless ``order_by`` tells another; ``read`` has options of the reader."""
        return cls._with(read_jdbc(spark, url, table, user, password, **(read or {})), order_by or key or [], {"key": key, "boundary": "clip", "sumif_empty": "null"} | options)

    @classmethod
    def _with(cls, df: DataFrame, order_by: Sequence[str], options: dict) -> Sheet:
        own = {k: options.pop(k) for k in ("precedence", "check_keys", "key") if k in options}
        made = Options(**options)
        if made.boundary not in ("null", "clip") or made.sumif_empty not in ("zero", "null"):
            raise SheetConfigError("boundary is 'null' or 'clip', sumif_empty 'zero' or 'null'")
        return cls(df, order_by, made, **own)

    @property
    def rows(self) -> int:
        """Rows of the sheet, counted once."""
        if self._rows is None:
            self._rows = self.source.count()
        return self._rows

    @property
    def letters(self) -> dict[str, str]:
        return {column_letters(i): name for i, name in enumerate(self.names)}

    def numbered(self) -> DataFrame:
        """The rows with their numbers, columns named by place."""
        if self._numbered is None:
            df, self._folder = number_rows(self.source, self.order_by, self.rows)
            # by place: names may repeat but for their case
            self._numbered = df.toDF(*[cell(i) for i in range(len(self.names))], ROW)
        return self._numbered

    def compute(self, formula: str, num_formulas: int | None = None, safe: bool = False) -> DataFrame | None:
        """The formula on each row, on the first ``num_formulas`` rows if given; with ``safe`` errors are printed and give None."""
        began = time.perf_counter()
        try:
            tree = parse(formula, self.precedence)
            parsed = time.perf_counter()
            check(tree, self.rows, len(self.names))
            checked = time.perf_counter()
            out = Compiler(self.numbered(), self.types, self.rows, self.options).run(tree)
        except GridError as e:
            if not safe:
                raise
            print(f"{type(e).__name__}: {e}")
            return None
        if num_formulas is not None:
            out = out.where(F.col("row_id") <= num_formulas)
        ended = time.perf_counter()
        self._metrics = {"parse_s": parsed - began, "check_s": checked - parsed, "plan_s": ended - checked, "total_s": ended - began}
        return out

    def compute_columns(self, formulas: dict[str, str]) -> DataFrame:
        """Several formulas, one column each, beside row_id."""
        out = None
        for name, formula in formulas.items():
            one = self.compute(formula).withColumnRenamed("value", name)
            out = one if out is None else out.join(one, "row_id")
        return out

    def explain(self, formula: str, mode: str = "formatted") -> None:
        """Prints the whole plan of a formula."""
        self.compute(formula).explain(mode)

    def head(self, n: int = 10, names: bool = True) -> DataFrame:
        """The first rows with lettered columns, as "A (name)" with ``names``."""
        df = self.numbered().orderBy(ROW).limit(n)
        labels = [f"{column_letters(i)} ({c})" if names else column_letters(i) for i, c in enumerate(self.names)]
        return df.select(F.col(ROW).alias("row_id"), *(F.col(cell(i)).alias(label) for i, label in enumerate(labels)))

    def show(self, n: int = 10, names: bool = True) -> None:
        self.head(n, names).show(n, truncate=False)

    def metrics(self) -> dict[str, float]:
        """Seconds of the last compute's phases; execution is Spark's own."""
        return dict(self._metrics)

    def reset_metrics(self) -> None:
        self._metrics = {}

    def persist(self) -> Sheet:
        """Keeps the numbered rows in memory, and on disk where they don't fit, for the formulas to come."""
        self.numbered().persist()
        return self

    def create_view(self, name: str) -> None:
        """The numbered rows as a temporary view: row_id, and columns by letter."""
        df = self.numbered()
        df.select(F.col(ROW).alias("row_id"), *(F.col(cell(i)).alias(column_letters(i)) for i in range(len(self.names)))).createOrReplaceTempView(name)

    def close(self) -> None:
        """Forgets the numbered rows and deletes what was written for them; results not yet computed can't be any more."""
        if self._numbered is not None:
            self._numbered.unpersist()
            self._numbered = None
        if self._folder is not None:
            delete(self.source.sparkSession, self._folder)
            self._folder = None
