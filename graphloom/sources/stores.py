"""Where graphs are kept: Parquet by predicate, JDBC tables, JSON; settings from a file and the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Triples in a folder a predicate, sorted by subject: a pattern reads one folder and skips row groups by subject."""
    triples.repartition("predicate", F.pmod(F.xxhash64("subject"), F.lit(64))).sortWithinPartitions("predicate", "subject").write.mode(mode).partitionBy("predicate").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def signature(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, size and time of every file under some paths of any store: equal as long as nothing was written there."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(conf).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def save_vectors(vectors: DataFrame, path: str, dims: int, mode: str = "overwrite") -> None:
    """Vectors (key, strategy, vec) in a folder a strategy; a vector of another length or a null one is an error, raised by the task that meets it, and nothing is kept."""
    fits = F.when(F.size("vec") == dims, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit(f"a vector must have {dims} components, not "), F.size("vec").cast("string"))))
    w = vectors.withColumn("vec", fits).write.mode(mode).partitionBy("strategy")
    # only the strategies that come are replaced, the others stay
    (w.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else w).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table of a database; with a numeric key and its bounds, read in parts. The driver jar has to be on the class path."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def to_json(df: DataFrame) -> DataFrame:
    """(json): a document a row, columns in order of name."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))


FUNCTIONS = {
    "cosine_sim": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN size(a) <> size(b) OR aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x) = 0 THEN 0D ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) / sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) END",
    "unit_score": "(x DOUBLE) RETURNS DOUBLE RETURN greatest(0D, least(1D, (x + 1) / 2))",
    "nearness_score": "(d INT) RETURNS DOUBLE RETURN CASE WHEN d = 0 THEN 1D WHEN d >= 10 THEN 0D ELSE 1 - d / 10D END",
    "support_score": "(n BIGINT) RETURNS DOUBLE RETURN least(n, 10) / 10D",
    "blend": "(w ARRAY<DOUBLE>, s ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN aggregate(zip_with(w, s, (x, y) -> if(y IS NULL, 0D, x)), 0D, (a, x) -> a + x) > 0 THEN aggregate(zip_with(w, s, (x, y) -> if(y IS NULL, 0D, x * y)), 0D, (a, x) -> a + x) / aggregate(zip_with(w, s, (x, y) -> if(y IS NULL, 0D, x)), 0D, (a, x) -> a + x) ELSE 0D END",
    "fusion_score": "(w ARRAY<DOUBLE>, similarity DOUBLE, confidence DOUBLE, days BIGINT, d INT, n BIGINT) RETURNS DOUBLE RETURN w[0] * greatest(0D, least(1D, (similarity + 1) / 2)) + w[1] * confidence + w[2] * pow(2D, -greatest(days, 0) / 30D) + w[3] * CASE WHEN d = 0 THEN 1D WHEN d >= 10 THEN 0D ELSE 1 - d / 10D END + w[4] * least(n, 10) / 10D",
}


def register_functions(spark: SparkSession) -> None:
    """The scores as SQL functions of the session, in native expressions."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


@dataclass(frozen=True)
class Settings:
    """Defaults, then a TOML file's [graphloom] table, then GRAPHLOOM_<NAME> in the environment, then arguments."""

    max_triples: int = 10_000
    max_nodes: int = 5_000
    target: float = 0.8
    decay_factor: float = 0.95
    least_weight: float = 0.01
    damping: float = 0.85
    iterations: int = 20
    co_access_least: int = 3
    expiry_hours: int = 24
    blend: str = "balanced"

    def __post_init__(self):
        if not (0 < self.target <= 1 and 0 <= self.decay_factor <= 1 and 0 < self.damping < 1 and self.max_triples > 0):
            raise ValueError("settings out of range")


def settings(path: str | None = None, env: dict[str, str] | None = None, **given) -> Settings:
    env = os.environ if env is None else env
    found: dict = {}
    if path:
        with open(path, "rb") as f:
            found |= tomllib.load(f).get("graphloom", {})
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    found |= {n: k(env[f"GRAPHLOOM_{n.upper()}"]) for n, k in kinds.items() if f"GRAPHLOOM_{n.upper()}" in env}
    unknown = set(found | given) - set(kinds)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(Settings(), **(found | given))
