"""Co-access counts and insert rates as Structured Streaming jobs over event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import embed, learning
from graphloom.sources import scratch

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet*", lateness: str = "10 minutes") -> DataFrame:
    """Events of a folder of Parquet files as a stream; rows later than the watermark are dropped by windowed state."""
    df = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 64).parquet(folder)
    return df.withWatermark("ts", lateness)


def insert_counts(events: DataFrame, seconds: int = 10) -> DataFrame:
    return events.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def context_refs(events: DataFrame, width: str = "1 day") -> DataFrame:
    """(user_id, start, refs): what each user read in a window."""
    ref = F.get_json_object("props", "$.k").cast("int")
    g = events.select("ts", "user_id", ref.alias("ref")).groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    return g.select("user_id", F.col("w.start").alias("start"), "refs")


def drain(df: DataFrame, out: str, checkpoint: str | None = None, mode: str = "complete") -> DataFrame:
    """Runs a stream over all there is and gives what it wrote, as a table. Each batch writes a folder of its own; of complete results the last batch's counts."""
    spark = df.sparkSession
    checkpoint = checkpoint or f"{out}-state"

    def write(batch: DataFrame, number: int) -> None:
        # a folder a batch: a batch that is tried again replaces its own, and no reader meets a half-deleted result
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    every = spark.read.schema(df.schema.add("batch", "long")).parquet(out)
    if mode == "complete":  # the last one holds everything
        every = every.where(F.col("batch") == (every.agg(F.max("batch")).first()[0] or 0))
    return every.drop("batch")


def shared(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stream's output under the shared one."""
    return scratch.new_dir(spark, f"stream-{name}")


def stream_insert_rate(spark: SparkSession, folder: str) -> DataFrame:
    got = drain(insert_counts(read_events(spark, folder)), shared(spark, "rate"))
    rate = F.col("n") / 10.0
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", rate.alias("rate"), learning.strategy(rate).alias("strategy"))


def stream_co_access(spark: SparkSession, folder: str, least: int = 3) -> DataFrame:
    got = drain(context_refs(read_events(spark, folder)), shared(spark, "coaccess"))
    return learning.pair_counts(got.select(F.concat_ws("@", F.col("user_id").cast("string"), F.col("start").cast("string")).alias("context"), "refs"), least)


def maintain(counts: DataFrame, facts: DataFrame, links: DataFrame, as_of, hours: int = 24, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(new links, contexts that stay) of one maintenance: what was read together is linked first, then old contexts expire. counts: (context, refs, ts)."""
    return learning.reinforce(learning.pair_counts(counts, least), facts, links), learning.unexpired(counts, as_of, hours)


def maintained(events: DataFrame, facts: DataFrame, links: DataFrame, out: str, hours: int = 24, least: int = 3, width: str = "1 day") -> DataFrame:
    """Runs ``maintain`` after each micro-batch over the windows seen so far; time is the newest window's start. Gives the links made, as a table."""
    spark, ran = events.sparkSession, []

    def run(batch: DataFrame, number: int) -> None:
        ctx = batch.select(F.concat_ws("@", F.col("user_id").cast("string"), F.col("start").cast("string")).alias("context"), "refs", F.col("start").alias("ts"))
        newest = ctx.agg(F.max("ts")).first()[0]
        if newest is not None:
            made, live = maintain(ctx, facts, links, F.lit(newest), hours, least)
            made.write.mode("overwrite").parquet(f"{out}/links/batch={number}")
            live.write.mode("overwrite").parquet(f"{out}/live/batch={number}")
            ran.append(number)

    q = context_refs(events, width).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(run).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/links").drop("batch").distinct() if ran else links.select("src", "dst").limit(0)


def sprung(inserted: DataFrame, vectors: DataFrame, out: str, dims: int, rate: float = 0.1) -> DataFrame:
    """Nudges vectors (node, vec) along the edges (src, dst) that a stream brings: each micro-batch reads the last version and writes the next."""
    spark = inserted.sparkSession
    vectors.select("node", "vec").write.mode("overwrite").parquet(f"{out}/version=0")

    def run(batch: DataFrame, number: int) -> None:
        old = spark.read.parquet(f"{out}/version={number}")
        both = batch.select("src", "dst")
        nodes = both.select(F.col("src").alias("node")).union(both.select("dst"))
        embed.spring(embed.first_vectors(nodes, both, old, dims), both.where("src <> dst"), rate).write.mode("overwrite").parquet(f"{out}/version={number + 1}")

    q = inserted.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(run).start()
    q.awaitTermination()
    last = (q.lastProgress or {}).get("batchId", -1) + 1
    return spark.read.parquet(f"{out}/version={last}")


def threads(events: DataFrame, sleep: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): threads of a user's reads; one sleeps when nothing was read for so long, and its state goes with the watermark."""
    return events.groupBy("user_id", F.session_window("ts", sleep).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_threads(spark: SparkSession, folder: str) -> DataFrame:
    got = drain(threads(read_events(spark, folder)), shared(spark, "threads"))
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
