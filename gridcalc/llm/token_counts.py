"""Token counts of documents from flat token files without an index, by a scan for end-of-document ids.

A file is ids of a fixed width and nothing else. Blocks of it are searched on their own: each yields the places of its
separators and how many ids follow its last one. A document that spans blocks, or files, is stitched by a prefix scan
over the blocks' summaries, inside each file by a window and over the files' totals, one row a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcalc.llm.common import bytes_of, fresh_path, open_fs, partitions, put_file, text_slices
from gridcalc.llm.token_files import encoder

#: Ids of one block of the scan.
BLOCK = 1 << 20


def width_for(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def write_flat(spark: SparkSession, df: DataFrame, tokenizer_json: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, int]], DataFrame]:
    """Encodes texts (special tokens' strings as plain text) into flat files in the order of the scan, each with its end id.

    Gives the files with their sizes in ids, and a table (file, ordinal, doc_id) of what was written where.
    """
    known = spark.sparkContext.broadcast(tokenizer_json)  # one vocabulary file
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("file", pa.int64()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        docs: list[pa.Array] = []
        total = 0

        def fill(out) -> None:
            nonlocal total
            own = encoder(known.value, plain_specials=True)
            kind = f"<u{width_for(own.vocabulary)}"
            for batch in text_slices(batches, 1):
                ids, counts = own.encode(bytes_of(batch.column(1)))
                flat = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                out.write(flat.astype(kind).tobytes())
                docs.append(batch.column(0))
                total += len(flat)

        put_file(f"{folder}/flat-{part:06d}.bin", fill)
        at = 0
        for d in docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), part)), pa.array(np.arange(at, at + len(d))), d, pa.array(np.full(len(d), total))], schema=schema)
            at += len(d)

    path = fresh_path(spark, "flat-docs")
    rows.mapInArrow(run, "file long, ordinal long, doc_id long, ids long").write.parquet(path)
    table = spark.read.schema("file long, ordinal long, doc_id long, ids long").parquet(path)
    sizes = {r.file: r.ids for r in table.groupBy("file").agg(F.max("ids").alias("ids")).collect()}  # one row a file
    return [(f"{folder}/flat-{k:06d}.bin", sizes[k]) for k in sorted(sizes)], table.select("file", "ordinal", "doc_id")


def scan(spark: SparkSession, files: list[tuple[str, int]], end_id: int, width: int, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) of every document, by the file that holds its end id; n_tokens without the end id.

    ``files`` follow one another as one stream. Ids after the last end id are no document. Empty files give nothing.
    """
    filled = [(k, uri, n) for k, (uri, n) in enumerate(files) if n]
    if not filled:
        return spark.createDataFrame([], "file long, ordinal long, n_tokens long")
    table = spark.createDataFrame(filled, "file long, uri string, ids long")
    table = table.select("file", "uri", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ids") - 1) / block))).alias("block"))
    table = table.select("file", "uri", "block", F.least(F.lit(block), F.col("ids") - F.col("block") * block).alias("n")).repartition(partitions(spark), "file", "block")
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("ends", pa.list_(pa.int64())), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, uri, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file_system, path = open_fs(uri)
                with file_system.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(n * width, b * block * width), f"<u{width}")
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([b]), pa.array([ends], schema.types[2]), pa.array([n])], schema=schema)

    found = table.mapInArrow(run, "file long, block long, ends array<long>, n long")
    n_ends = F.size("ends")
    found = found.withColumns({"count": n_ends.cast("long"), "open": F.when(n_ends > 0, F.col("n") - F.element_at("ends", -1) - 1).otherwise(F.col("n"))})
    # the prefix scan: documents ended before each block, and ids since the last end
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("block") * block
    last_end = F.when(F.col("count") > 0, place + F.element_at("ends", -1))
    stitched = found.withColumns({"ordinal": F.coalesce(F.sum("count").over(before), F.lit(0)), "since": F.max(last_end).over(before)})
    summary = {r.file: r for r in found.groupBy("file").agg(F.sum("n").alias("n"), F.max(last_end).alias("last")).collect()}  # one row a file
    carried, carry = [], 0
    for k in range(len(files)):
        carried.append((k, carry))
        if k in summary:
            r = summary[k]
            carry = carry + r.n if r.last is None else r.n - r.last - 1
    stitched = stitched.join(F.broadcast(spark.createDataFrame(carried, "file long, carry long")), "file")
    first = place + F.col("ends")[0] - F.coalesce(F.col("since") + 1, -F.col("carry"))
    rest = F.transform(F.sequence(F.lit(1), F.col("count")), lambda i: F.get("ends", i.cast("int")) - F.get("ends", i.cast("int") - 1) - 1)
    lengths = F.concat(F.array(first), F.slice(rest, F.lit(1), (F.col("count") - 1).cast("int")))
    out = stitched.where("count > 0").select("file", "ordinal", F.posexplode(lengths).alias("k", "n_tokens"))
    return out.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens")


def token_counts(spark: SparkSession, df: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens) per row of ``df``: its texts are written as flat files, which are then scanned.

    Null texts count as empty and have no tokens; null and repeated ids are kept; an empty table gives an empty result.
    """
    files, docs = write_flat(spark, df, tokenizer_json, end_id, fresh_path(spark, "flat"))
    if not files:
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    names = spark.createDataFrame([(int(uri[-10:-4]), k) for k, (uri, _) in enumerate(files)], "file long, place long")
    docs = docs.join(F.broadcast(names), "file").select(F.col("place").alias("file"), "ordinal", "doc_id")  # one row a file
    width = width_for(encoder(tokenizer_json, plain_specials=True).vocabulary)
    return docs.join(scan(spark, files, end_id, width), ["file", "ordinal"]).select("doc_id", "n_tokens")
