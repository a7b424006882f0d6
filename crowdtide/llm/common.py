"""Shared helpers: tables in the shared folder, whole-text columns, and array hashing inside Arrow tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows in an Arrow batch for the writes inside: texts are long, and two copies of a batch are in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends in files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with arrow_rows(spark, 1000):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole(column: str | Column) -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def bucket_of(column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(buckets))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Columns ``idx`` (place in the group by ``order``, from 0) and ``total`` (rows of the group); ``group`` holds no nulls, nulls of ``order`` come first.

    Rows are dealt by ranges of group and order, so that a group of any size spreads over tasks; a place is that in the task plus the counts of the
    tasks before it.  Rows equal in all of ``order`` follow each other in an order that is the same when a task is run again.
    """
    c, cuts = F.col, [*group, *order, "_salt"]
    dealt = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*cuts).sortWithinPartitions(*cuts)
    rows = stored(dealt.drop("_salt").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), name)
    counts = rows.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*group)
    before = F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", *group, (c("_first") - F.coalesce(before, F.lit(0))).alias("_zero"), F.sum("_n").over(w).alias("total"))
    return rows.join(starts, ["_part", *group]).select(*df.columns, (c("_at") - c("_zero")).alias("idx"), "total")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# ---- inside tasks -----------------------------------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15
WRAP = 1 << 64


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand; one object per task."""

    def __init__(self, base: int = BASE):
        self.base, self.size = base | 1, 0
        self.up = self.down = np.ones(0, np.uint64)

    def need(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 16)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, WRAP))):
                steps = np.full(self.size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


def prefix_hash(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of values[i] * base**i modulo 2**64; one entry more than ``values``."""
    powers.need(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of the spans [start, end): equal for equal contents wherever they stand."""
    return (prefix[end] - prefix[start]) * powers.down[start]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) for runs of rows with about ``limit`` bytes of text; one longer text makes a run of its own."""
    texts = batch.column(column)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last - first, raw[at[first]: at[last]], at[first: last + 1] - at[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of word bytes that does not cross a text; offsets as in ``slices``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = mask[:-1], mask[1:]
    return np.flatnonzero(after & (edge | ~before)), np.flatnonzero(before & (edge | ~after))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hash of every word; ``fold`` maps bytes (lower case)."""
    prefix = prefix_hash(fold[data].astype(np.uint64) + np.uint64(1), powers)
    return mix(span_hash(prefix, starts, ends, powers) + (ends - starts).astype(np.uint64))


def ascii_lower() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold
