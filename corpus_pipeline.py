"""Training-data pipeline over the documents table: classify, deduplicate, redact, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes each
result as Parquet into the shared folder and reads it again for the next one.

Defined cases, every stage: an empty table gives an empty one; columns beyond those of documents, whatever their names, go
through all stages but the last, which returns its own; rows are judged by themselves or their group, so their order and
partitions don't matter (of rows alike in everything that is compared, any one is kept). Null, empty, tied and repeated
rows are stated at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, mixing, pii, quality_classifier, simhash
from graphloom.llm.common import components, keep, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality scorer keeps. Null, empty and wordless texts go; a score of exactly a half is kept; equal texts are judged equally, so repeated rows all stay or all go."""
    return quality_classifier.filter_documents(docs, quality_classifier.fit(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest doc_id (rows without one come last), then with the least text hashes.

    Rows, not ids, are compared: texts that share a doc_id, and rows without one, stay or go each by its own group.
    """
    marked = docs.withColumns({"text_h1": F.xxhash64("text"), "text_h2": F.xxhash64(F.lit(1), "text")})
    fps = keep(simhash.fingerprints(marked, more=("text_h1", "text_h2")))
    roots = components(simhash.links(fps))
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_h1", "text_h2")
    least = fps.groupBy("fp").agg(F.min(row).alias("row")).join(roots, F.col("fp") == F.col("node"), "left")
    first = keep(least.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("row").alias("row")).select("row.*").toDF("nameless", "first_id", "first_h1", "first_h2").drop("nameless"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("first_id")) & (F.col("text_h1") == F.col("first_h1")) & (F.col("text_h2") == F.col("first_h2"))
    return marked.join(first, same, "left_semi").dropDuplicates(["doc_id", "text_h1", "text_h2"]).select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind. A null text stays null; where spans tie or overlap, the earlier and then the longer one names the stretch; repeated rows are redacted alike."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the sources' target weights, repeated where the mix takes them more than once. A null source is one of its own; texts without a word cost nothing and stay once; rows tied in the hash order go by size."""
    return mixing.materialise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every document of the mix. A null or empty text has no token; repeated rows are encoded alike."""
    e = bpe.encode(docs)
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_classifier", classify), ("simhash_dedup", deduplicate), ("pii", redact), ("mixing", mix), ("bpe", encode)]

#: The learnt stages can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
