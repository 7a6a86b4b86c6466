"""Shared helpers of the training-data operators: shared scratch tables, word rules, components."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.scratch import shared_dir

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_dir(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clean)
    _scratch.append((spark, path))
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def _clean() -> None:
    for spark, path in _scratch:
        with contextlib.suppress(Exception):  # the session may be gone by now; the next folder may still go
            drop_dir(spark, path)


class Kept:
    """A written table in the shared folder: cuts lineage, survives lost executors, has a known size."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = new_dir(self.spark)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_dir(self.spark, self.path)


def keep(df: DataFrame) -> DataFrame:
    return Kept(df).df


def pieces(batches, rows: int):
    """The batches cut into slices of at most so many rows. Spark bounds a batch's bytes itself, so no session setting is touched."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def tidy(run, rows: int = 500):
    """A mapInArrow function that sees a few rows at a time and gives its memory back to the system when its task ends: Python workers outlive their tasks."""

    def wrapped(batches):
        try:
            yield from run(pieces(batches, rows))
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not every C library has it
                pass

    return wrapped


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of (a, b) longs by alternating large-star and small-star rounds.

    Every step is an aggregation with map-side combine and an equi-join, so a hub is one aggregate row
    and a join key that adaptive execution can split. Returns (node, root), root the smallest node of
    the component, for every node with an edge. Nothing is collected but one fingerprint per round.
    """
    old = Kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = old.df.union(old.df.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours point to the smallest neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        step = Kept(large)
        # small star: smaller neighbours and the node point to the smallest neighbour
        low = step.df.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            step.df.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        new = Kept(small)
        step.drop()
        old.drop()
        old = new
        sign = tuple(new.df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components did not settle")
    return old.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
