"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets.

DataFrame functions only. Sources, by code point with null last, weigh 5, 2, 1 repeating and share all
words; a target stops at ``epochs`` times its source's size, the excess going to the others by weight.
Within a source, documents are ordered by a hash key. The key range is cut into buckets of some thousand
documents; bucket sums and their prefix sums give each bucket's offset, a window inside the bucket gives
each document's. So a hot source is dealt over as many tasks as it has buckets, and only its bucket sums
meet in one window (at most ``MAX_BUCKETS`` rows a source, whatever the input).

``taken`` is how many words of the document the mix takes: whole epochs, then whatever the source's
budget has left at the document's place in the order; the document that the budget ends in gives only a
part. A source's taken words are its target rounded down.

Defined cases: null text has size 0 and nothing is taken; null source is a source of its own, the last
one; a null doc_id is a key like any other; rows with equal keys are ordered by size, and equal rows share
their part in any order; an empty table gives an empty result; all other columns pass through
``materialise`` untouched and are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep, table

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
PER_BUCKET, MAX_BUCKETS = 2000, 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(src, source_size, docs, target) a source. sizes: (source, size).

    The fixed point of sharing by weight with caps is a water level: sources sorted by cap over weight
    are full up to some place, and the others get the level times their weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    place = Window.orderBy(F.col("source").isNull(), "source")
    k = len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(k)) + 1).cast("int"))
    per = per.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    # by cap / weight; compared exactly through the rank of the quotient, ties by place
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    per = (
        per.withColumn("full", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("free", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
    )
    # the level if exactly the sources before this one are full; the first that it doesn't fill sets the level
    level = (F.col("total") - F.col("full")) / F.col("free")
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    per = per.withColumn("lambda", F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("q"), "level"))).over(everything)["level"])
    target = F.when(F.col("lambda").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("lambda") * F.col("w")))
    return per.select(F.col("source").alias("src"), "source_size", "docs", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) a row. carry: further columns to keep."""
    size = F.coalesce(F.expr(f"regexp_count(text, r'{WORD}')"), F.lit(0)).cast("long")
    key = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    base = docs.select("doc_id", "source", size.alias("size"), *(carry or []))
    sized = base if carry else keep(base)
    sized = sized.withColumn("key", key)
    per = keep(targets(sized.select("source", "size"), weights, epochs))
    at = sized.join(per, sized["source"].eqNullSafe(per["src"])).drop("src")
    # the key's first 40 bits spread documents evenly over their source's buckets, in key order
    nb = F.least(F.ceil(F.col("docs") / PER_BUCKET), F.lit(MAX_BUCKETS)).cast("long")
    at = at.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 10), 16, 10).cast("long") * nb / F.lit(1 << 40)).cast("int"))
    sums = at.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = F.coalesce(F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = keep(sums.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), before.alias("offset")))
    at = at.join(offsets, at["source"].eqNullSafe(offsets["s2"]) & (at["bucket"] == offsets["b2"])).drop("s2", "b2")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor(F.col("target")).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    left = budget - whole * F.col("source_size") - F.col("start")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return at.withColumn("taken", taken.cast("long")).select("doc_id", "source", "size", "source_size", "target", "taken", *(carry or []))


def materialise(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed documents: a row for each epoch; a part counts as a whole if it is half a document or more.

    Documents without a word take no budget and stay once. All input columns come back.
    """
    kept = docs.columns
    nested = docs.select(F.col("doc_id"), F.col("source"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    got = mix(nested, weights, epochs, seed, ["row"])
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.expr("(2 * taken + size) div (2 * size)").cast("int"))
    return got.withColumn("times", times).where("times > 0").select(F.explode(F.array_repeat("row", F.col("times").cast("int"))).alias("row")).select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w, {EPOCHS} * source_size AS cap FROM per),
levels AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
         sum(source_size) OVER () AS total FROM weighed),
opened AS (SELECT *, CAST(total - filled AS DOUBLE) / CAST(free AS DOUBLE) AS level FROM levels),
lam AS (SELECT level AS lvl FROM opened WHERE level * w <= cap ORDER BY cap / w, level LIMIT 1),
per_source AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT lvl FROM lam) * w, cap)) AS target FROM opened),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN CAST(floor(p.target) AS BIGINT) // p.source_size ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN per_source p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - start)) AS BIGINT) AS taken
FROM placed
"""
