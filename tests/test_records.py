"""Sessions that refer to what is not there, stored vectors, streams that maintain links and vectors, schedules."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom.operators import embed, learning, sessions, store
from graphloom.sources import stores
from graphloom.streaming import access

SESSION = "session_id long, platform string, project string, room string, status string, created timestamp_ntz, updated timestamp_ntz, ended timestamp_ntz, summary string, themes array<string>"


def held(spark):
    at = lambda n: dt.datetime(2024, 1, n)
    return spark.createDataFrame([(1, "api", "p", "r", "active", at(1), at(1), None, "old", ["x"]), (2, "chat", "p", "r", "active", at(2), at(2), None, None, [])], SESSION)


def test_sessions(spark):
    s = held(spark)
    assert sessions.active_in(s, "r").first().session_id == 2 and sessions.active_in(s, "none").count() == 0
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    e = sessions.end(s, 1, now).where("session_id = 1").first()
    assert (e.status, e.summary, e.themes, e.ended) == ("ended", "old", ["x"], dt.datetime(2024, 2, 1))  # kept where none is given
    with pytest.raises(KeyError):
        sessions.end(s, 9, now)
    with pytest.raises(KeyError):
        sessions.update(s, s.withColumn("session_id", F.lit(9).cast("long")))
    rows = spark.createDataFrame([(1, "hello")], "session_id long, text string")
    assert sessions.add(rows, rows, s).count() == 2
    with pytest.raises(KeyError):
        sessions.add(rows, rows.withColumn("session_id", F.lit(9).cast("long")), s)


def test_vectors_are_checked_and_replaced_by_strategy(spark, tmp_path):
    kind = "node string, strategy string, vec array<double>"
    path = str(tmp_path / "v")
    stores.save_vectors(spark.createDataFrame([("a", "spring", [1.0, 2.0]), ("a", "spectral", [3.0, 4.0])], kind), path, 2)
    back = embed.recompute(spark, path, spark.createDataFrame([("b", [5.0, 6.0])], "node string, vec array<double>"), "spectral", 2)
    assert sorted((r.node, r.strategy) for r in back.collect()) == [("a", "spring"), ("b", "spectral")]
    with pytest.raises(Exception, match="a vector must have 2 components"):
        stores.save_vectors(spark.createDataFrame([("c", "spring", [1.0])], kind), path, 2)


def test_schedule_waits_for_the_cooldown(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=10 * i), 200.0) for i in (0, 1, 5, 6, 7, 12, 40)] + [(start + dt.timedelta(seconds=5000), 50.0)]
    ran = learning.recomputed(spark.createDataFrame(rows, "start timestamp_ntz, rate double"), "spectral", 60)
    assert sorted((r.start - start).seconds for r in ran.collect()) == [0, 60, 120, 400]


def test_resolution_names_both_and_the_reason(spark):
    pairs = spark.createDataFrame([("a", "b")], "a_id string, b_id string")
    facts = {r.p: (r.s, r.o) for r in store.resolution_facts(pairs, "keep_a", "older").collect()}
    assert facts[store.SETTLED] == ("a", "b") and facts[store.ACTION][1] == "keep_a" and facts[store.REASONING][1] == "older"


def test_streams_link_and_nudge(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [{"event_id": i, "ts": at + dt.timedelta(days=i // 2), "user_id": 1, "event_type": "view", "value": 0.0, "props": f'{{"k": {i % 2}}}'} for i in range(8)]
    (tmp_path / "in").mkdir()
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "in/events.parquet")
    facts = spark.createDataFrame([(0, "a", "b"), (1, "c", "d")], "ref int, src string, dst string")
    none = spark.createDataFrame([], "src string, dst string")
    got = access.maintained(access.read_events(spark, str(tmp_path / "in")), facts, none, str(tmp_path / "out"))
    assert sorted((r.src, r.dst) for r in got.collect()) == [("a", "c"), ("b", "d")]
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    edges.write.parquet(str(tmp_path / "edges"))
    vectors = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0])], "node string, vec array<double>")
    moved = access.sprung(spark.readStream.schema("src string, dst string").parquet(str(tmp_path / "edges")), vectors, str(tmp_path / "vecs"), 3)
    assert {r.node: r.vec for r in moved.collect()} == {"a": pytest.approx([0.9, 0.1, 0]), "b": pytest.approx([0.1, 0.9, 0])}
