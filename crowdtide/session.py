"""Session helpers: builder for local work, checkpoint folder, hot-key split join."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "crowdtide", master: str = "local[*]", **conf: str) -> SparkSession:
    b = (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir.  A local session that names none (tests) gets a private one; a cluster has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="crowdtide-"))
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder, so that two runs never meet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: survives the loss of any executor.

    A checkpoint would keep the size that the planner guessed for the frame, which multiplies with every join and soon stops plans from ending; files have their own.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    if scopes := getattr(_cut, "scopes", None):
        scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_cut = threading.local()  # paths that ``cut_lineage`` wrote in this thread, by open ``passing``


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Frames that ``cut_lineage`` writes inside are deleted at the end: nothing made inside may be read later but what was written elsewhere."""
    _cut.scopes = [*getattr(_cut, "scopes", []), []]
    try:
        yield
    finally:
        *_cut.scopes, paths = _cut.scopes
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, written as by ``cut_lineage``; the frames cut on the way to it are deleted, so that the folder holds no more than the steps that still run need."""
    outer = getattr(_cut, "scopes", [])
    with passing(spark):
        out = cut_lineage(make())
        path = _cut.scopes[-1].pop()
    if outer:
        outer[-1].append(path)
    return out


def split_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner",
               on: Column | None = None, rows_per_split: int = 1_000_000, hot_from: DataFrame | None = None) -> DataFrame:
    """Equi-join that cuts any key of ``many`` with more than ``rows_per_split`` rows into several sub-keys.

    Rows of ``many`` under a hot key go to one of n sub-keys by row hash; the matching rows of ``few`` are copied to all
    n.  Null keys meet nothing and stay out of the split; whether the hot-key table is broadcast is left to the planner, while the sides of
    the join itself never are: their sizes are guesses where a generator made their rows.  ``how`` may
    be inner, left or left_semi/left_anti with ``many`` on the left.  ``hot_from`` is a cheaper frame with the same keys to count
    (an earlier checkpoint of ``many``), so that a long plan is not run twice.
    """
    hot = (
        (many if hot_from is None else hot_from).groupBy(*keys).count()
        .where(F.col("count") > rows_per_split)
        .select(*keys, F.ceil(F.col("count") / rows_per_split).cast("int").alias("_splits"))
    )
    many = (
        many.join(hot, keys, "left")
        .withColumn("_part", F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*[F.col(c) for c in many.columns]), F.col("_splits")).cast("int")))
        .drop("_splits")
    )
    few = (
        few.join(hot, keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)))
        .drop("_splits")
    )
    out = many.join(few.hint("merge"), [*keys, "_part"], how)
    if on is not None:
        out = out.where(on)
    return out.drop("_part")


@contextmanager
def dealt_by_part_of_keys(spark: SparkSession) -> Iterator[None]:
    """Joins written inside take rows that are dealt by some of their keys as they are, instead of dealing them again by all."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join_in_blocks(left: DataFrame, links: DataFrame, right: DataFrame, block: list[str], on_left: str, on_right: str, rows_per_split: int = 200_000) -> DataFrame:
    """Rows of ``left`` and ``right`` of one block that a row of ``links`` (block, on_left, on_right) ties.

    Written under ``dealt_by_part_of_keys``, all three are dealt by block alone, once: the rows of ``left`` times their links, which outnumber the tables, live only
    inside the tasks.  A block with more than ``rows_per_split`` rows of ``left`` is cut into parts, to each of which its links and rows of ``right`` are copied.  The blocks
    hold no nulls.
    """
    hot = left.groupBy(*block).count().where(F.col("count") > rows_per_split).select(*block, F.ceil(F.col("count") / rows_per_split).cast("int").alias("_splits"))
    splits = F.coalesce("_splits", F.lit(1))
    many = left.join(hot, block, "left").withColumn("_part", F.pmod(F.xxhash64(*[F.col(x) for x in left.columns]), splits).cast("int")).drop("_splits")
    few = [df.join(hot, block, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), splits - 1))).drop("_splits") for df in (links, right)]
    at = [*block, "_part"]
    met = many.repartition(*at).join(few[0].repartition(*at).hint("merge"), [*at, on_left])
    return met.join(few[1].repartition(*at).hint("merge"), [*at, on_right]).drop("_part")


def left_lookup(many: DataFrame, few: DataFrame, keys: list[str], tasks: int = 1024) -> DataFrame:
    """Left equi-join in which rows without a key, which meet nothing, are spread over tasks instead of landing in one."""
    plain = [c for c, kind in many.dtypes if "map<" not in kind and "variant" not in kind]
    none = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    many = many.withColumn("_spread", F.when(none, F.pmod(F.xxhash64(*[F.col(c) for c in plain]), F.lit(tasks)).cast("int")).otherwise(F.lit(0)))
    zero = F.pmod(F.hash(*keys), F.lit(1))  # a literal would be folded into a filter and leave the join key
    return many.join(few.withColumn("_spread", zero), [*keys, "_spread"], "left").drop("_spread")


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add computed columns once and for all: later filters and expressions refer to them by name instead of repeating their text.

    A one-element generator does this inside the same stage.  Predicates on other columns still pass below it to the scan.
    """
    taken = [c for c in df.columns if c not in columns]
    return df.select(*taken, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
