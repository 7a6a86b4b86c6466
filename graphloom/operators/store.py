"""Immutable versions of a knowledge graph: ingest, look-up, update, provenance, hot and cold tiers.

A graph is three DataFrames: nodes (id, value), triples and bridge (source_id, triple_id). An operator takes
DataFrames and returns a new version; nothing is changed in place, and every time is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.sources.scratch import settle


def nodes(facts: DataFrame) -> DataFrame:
    """(id, value) of every distinct subject and object of (s, p, o, ...)."""
    both = facts.select(F.col("s").alias("value")).union(facts.select("o")).distinct()
    return both.select(ids.node_id(F.col("value")).alias("id"), "value")


def triples(facts: DataFrame) -> DataFrame:
    """Content-addressed triples of (s, p, o, w, ts); equal facts are one row, the last stated one."""
    last = facts.groupBy("s", "p", "o").agg(F.max(F.struct("ts", "w")).alias("x"))
    s, o = ids.node_id(F.col("s")), ids.node_id(F.col("o"))
    return last.select(
        ids.triple_id(s, F.col("p"), o).alias("id"), s.alias("subject"), F.col("p").alias("predicate"), o.alias("object"),
        F.lit(None).cast("string").alias("origin_did"), F.col("x.ts").alias("timestamp"), F.lit(1.0).alias("base_weight"),
        F.col("x.w").alias("local_weight"), F.col("x.ts").alias("last_accessed"), F.lit(0).cast("long").alias("access_count"),
    )


def effective_weight() -> Column:
    return F.col("base_weight") * F.col("local_weight")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", on_conflict: str = "replace") -> DataFrame:
    """Rows of new take the place of old ones with the same key, or give way to them (on_conflict="keep")."""
    if on_conflict not in ("replace", "keep"):
        raise ValueError("on_conflict is replace or keep")
    new = new.dropDuplicates([key])
    if on_conflict == "keep":
        return old.unionByName(new.join(old.select(key), key, "left_anti"))
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def touch(t: DataFrame, wanted: DataFrame, as_of: Column) -> DataFrame:
    """Triples whose id is in wanted are read: full local weight, one more access."""
    hit = F.col("_hit").isNotNull()
    marked = t.join(wanted.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left")
    return marked.select(*[
        F.when(hit, as_of).otherwise(F.col(c)).alias(c) if c == "last_accessed"
        else F.when(hit, F.col(c) + 1).otherwise(F.col(c)).alias(c) if c == "access_count"
        else F.when(hit, 1.0).otherwise(F.col(c)).alias(c) if c == "local_weight" else F.col(c)
        for c in t.columns
    ])


def delete(t: DataFrame, bridge: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the triples of gone (id) and their provenance; nodes stay."""
    return t.join(gone, "id", "left_anti"), bridge.join(gone.select(F.col("id").alias("triple_id")), "triple_id", "left_anti")


def match(t: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None, limit: int | None = None) -> DataFrame:
    """Triples that agree with every bound position (ids); all three may be open."""
    for c, v in (("subject", subject), ("predicate", predicate), ("object", obj)):
        if v is not None:
            t = t.where(F.col(c) == v)
    return t.orderBy("id").limit(limit) if limit is not None else t


def match_values(t: DataFrame, n: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None, strict: bool = True) -> DataFrame:
    """match by node values. An unknown value matches nothing; strict=False treats it as open, as a lenient server would."""
    sid, oid = (None if v is None else ids.node_id(F.lit(v)) for v in (subject, obj))
    if predicate is not None:
        t = t.where(F.col("predicate") == predicate)
    for c, v, i in (("subject", subject, sid), ("object", obj, oid)):
        if v is None or (not strict and not n.where(F.col("value") == v).take(1)):
            continue
        t = t.where(F.col(c) == i)  # the id is a constant: it reaches the scan as a filter
    return t


def resolved(t: DataFrame, n: DataFrame) -> DataFrame:
    """Triples with their nodes' values (s, o). Both are equi-joins; Spark broadcasts nodes only if they are small."""
    a, b = n.toDF("subject", "s"), n.toDF("object", "o")
    return t.join(a, "subject").join(b, "object")


def with_sources(t: DataFrame, bridge: DataFrame, sources: DataFrame) -> DataFrame:
    """Triples with an array of their sources (id, source_type, reference), by source id."""
    per = bridge.join(sources, "source_id").groupBy(F.col("triple_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("source_id", "source_type", "reference"))).alias("sources"))
    return t.join(per, "id", "left")


def source_counts(t: DataFrame, bridge: DataFrame) -> DataFrame:
    """(id, n_sources) of every triple, 0 without any."""
    per = bridge.groupBy(F.col("triple_id").alias("id")).agg(F.count("*").alias("n_sources"))
    return t.select("id").join(per, "id", "left").select("id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def by_id(t: DataFrame, value: str) -> DataFrame:
    """The node or triple of an id; the id is a constant, so a sorted store skips row groups."""
    return t.where(F.col("id") == value)


def resolve(n: DataFrame, identifier: str) -> str:
    """The id of a node that is named by its id or else by its value; an error if there is none."""
    row = n.where(F.col("id") == identifier).select("id").first() or n.where(F.col("value") == identifier).select("id").first()
    if row is None:
        raise KeyError(f"no such node: {identifier}")
    return row.id


def ingest(facts: DataFrame, source_id: str, source_type: str, reference: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(triples, bridge, source) of one request: distinct triples of (s, p, o, w, ts) and one source that spans all of them."""
    t = triples(facts)
    source = facts.sparkSession.sql("SELECT 1").select(F.lit(source_id).alias("source_id"), F.lit(source_type).alias("source_type"), F.lit(reference).cast("string").alias("reference"))
    return t, t.select(F.lit(source_id).alias("source_id"), F.col("id").alias("triple_id")), source


def trust(pairs: DataFrame) -> DataFrame:
    """(s, p, o) facts of pairs (truster, trusted)."""
    return pairs.select(F.col("truster").alias("s"), F.lit("trusts").alias("p"), F.col("trusted").alias("o"))


def shares(facts: DataFrame) -> DataFrame:
    """(triple_id, recipient, retracted) of every share among (s, p, o) facts."""
    gone = facts.where("p = 'retracted_by'").select(F.col("s").alias("triple_id")).distinct().withColumn("_gone", F.lit(True))
    rows = facts.where("p = 'shareable_with'").select(F.col("s").alias("triple_id"), F.col("o").alias("recipient"))
    return rows.join(gone, "triple_id", "left").select("triple_id", "recipient", F.coalesce("_gone", F.lit(False)).alias("retracted"))


def predicate_counts(t: DataFrame) -> DataFrame:
    """(subject, counts): a map of how many triples of each predicate a subject has."""
    per = t.groupBy("subject", "predicate").agg(F.count("*").alias("n"))
    return per.groupBy("subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "n")))).alias("counts"))


def search_nodes(n: DataFrame, part: str, limit: int) -> DataFrame:
    """Nodes whose value holds part, whatever the case, first in order of value."""
    return n.where(F.contains(F.lower("value"), F.lit(part.lower()))).orderBy("value").limit(limit)


def stats(t: DataFrame) -> DataFrame:
    both = t.select(F.col("subject").alias("n")).union(t.select("object")).agg(F.countDistinct("n").alias("n_nodes"))
    return t.agg(F.count("*").alias("n_triples"), F.round(F.avg("local_weight"), 6).alias("avg_weight"), F.round(F.sum("local_weight"), 4).alias("total_weight")).crossJoin(both)  # one row each


def reify(t: DataFrame, predicate: str, value: Column) -> DataFrame:
    """(s, p, o) facts about triples: the triple's id is the subject's value."""
    return t.select(F.col("id").alias("s"), F.lit(predicate).alias("p"), value.alias("o"))


def supersede(t: DataFrame, pairs: DataFrame, damp: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Old triples of pairs (new_id, old_id, reason) weigh a tenth; facts say which supersede them and why."""
    old = pairs.select(F.col("old_id").alias("id")).distinct().withColumn("_old", F.lit(1))
    damped = t.join(old, "id", "left").withColumn("local_weight", F.when(F.col("_old").isNotNull(), F.col("local_weight") * damp).otherwise(F.col("local_weight"))).drop("_old")
    facts = pairs.select(F.col("new_id").alias("s"), F.lit("supersedes").alias("p"), F.col("old_id").alias("o"))
    why = pairs.where("reason is not null").select(F.col("new_id").alias("s"), F.lit("supersede_reason").alias("p"), F.col("reason").alias("o"))
    return damped, facts.unionByName(why)


def share(t: DataFrame, recipient: str) -> DataFrame:
    return reify(t, "shareable_with", F.lit(recipient))


def revoke(t: DataFrame, gone: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Retracted triples weigh nothing; facts say by whom and when."""
    hit = gone.select("id").distinct().withColumn("_hit", F.lit(1))
    off = t.join(hit, "id", "left").withColumn("local_weight", F.when(F.col("_hit").isNotNull(), 0.0).otherwise(F.col("local_weight"))).drop("_hit")
    return off, reify(gone, "retracted_by", F.lit("local")).unionByName(reify(gone, "retracted_at", F.lit(as_of)))


def verify(t: DataFrame, verifier: str, result: str, reasoning: str | None = None) -> DataFrame:
    """Facts of a verification: who verifies which triple, and what came out."""
    if result not in ("confirmed", "contradicted", "uncertain"):
        raise ValueError("a verification is confirmed, contradicted or uncertain")
    about = F.concat(F.lit(f"{verifier}->"), F.col("id"))
    out = t.select(F.lit(verifier).alias("s"), F.lit("verifies").alias("p"), F.col("id").alias("o")).unionByName(t.select(about.alias("s"), F.lit("verification_result").alias("p"), F.lit(result).alias("o")))
    return out if reasoning is None else out.unionByName(t.select(about.alias("s"), F.lit("verification_reasoning").alias("p"), F.lit(reasoning).alias("o")))


def verifications(facts: DataFrame) -> DataFrame:
    """(verifier, triple_id, result, reasoning) from (s, p, o) facts."""
    v = facts.where("p = 'verifies'").select(F.col("s").alias("verifier"), F.col("o").alias("triple_id")).withColumn("about", F.concat("verifier", F.lit("->"), "triple_id"))
    r = facts.where("p = 'verification_result'").select(F.col("s").alias("about"), F.col("o").alias("result"))
    w = facts.where("p = 'verification_reasoning'").select(F.col("s").alias("about"), F.col("o").alias("reasoning"))
    return v.join(r, "about", "left").join(w, "about", "left").drop("about")


#: Predicates that may have many objects.
MULTI_VALUED = ("knows", "likes", "trusts", "shareable_with", "verifies", "supersedes")


def tensions(t: DataFrame, severity: str | None = None) -> DataFrame:
    """Pairs of live triples with one subject and predicate but different objects, lesser id first."""
    live = t.where((F.col("local_weight") > 0) & ~F.col("predicate").isin(*MULTI_VALUED)).select("id", "subject", "predicate", "object")
    a, b = live.toDF("a_id", "subject", "predicate", "a_object"), live.toDF("b_id", "subject", "predicate", "b_object")
    level = F.when(F.col("predicate").isin("is", "is_a", "has_type"), "high").otherwise("medium")
    out = a.join(b, ["subject", "predicate"]).where("a_id < b_id and a_object <> b_object").select("subject", "predicate", "a_id", "b_id", level.alias("severity"))
    return out if severity is None else out.where(F.col("severity") == severity)


def resolve_tensions(t: DataFrame, pairs: DataFrame, action: str, damp: float = 0.1) -> DataFrame:
    """Losers of pairs (a_id, b_id) weigh a tenth: b for keep_a, a for keep_b, both for archive_both."""
    lost = {"keep_a": ["b_id"], "keep_b": ["a_id"], "keep_both": [], "archive_both": ["a_id", "b_id"]}[action]
    if not lost:
        return t
    gone = pairs.select(F.explode(F.array(*lost)).alias("id")).distinct().withColumn("_lost", F.lit(1))
    return t.join(gone, "id", "left").withColumn("local_weight", F.when(F.col("_lost").isNotNull(), F.col("local_weight") * damp).otherwise(F.col("local_weight"))).drop("_lost")


def resolve_all_tensions(t: DataFrame, action: str, damp: float = 0.1) -> DataFrame:
    """resolve_tensions for every tension of t, without its pairs: a triple loses if one before it by id (after it for keep_b) has another object."""
    back, on = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    sides = {"keep_a": [back], "keep_b": [on], "keep_both": [], "archive_both": [back, on]}[action]
    if not sides:
        return t
    live = (F.col("local_weight") > 0) & ~F.col("predicate").isin(*MULTI_VALUED) & F.col("subject").isNotNull() & F.col("object").isNotNull() & F.col("id").isNotNull()
    place, other = Window.partitionBy("subject", "predicate").orderBy("id"), F.when(live, F.col("object"))
    lost = F.lit(False)
    for side in sides:
        w = place.rowsBetween(*side)
        lost = lost | F.coalesce((F.min(other).over(w) != F.col("object")) | (F.max(other).over(w) != F.col("object")), F.lit(False))
    marks = t.withColumn("_lost", lost & F.coalesce(live, F.lit(False)))
    return marks.withColumn("local_weight", F.when(F.col("_lost"), F.col("local_weight") * damp).otherwise(F.col("local_weight"))).drop("_lost")


#: Predicates of what is recorded about a settled tension.
SETTLED, ACTION, REASONING = "tension_resolved_with", "tension_resolution_action", "tension_resolution_reasoning"


def resolution_facts(pairs: DataFrame, action: str, reasoning: str) -> DataFrame:
    """(s, p, o) facts about settled pairs (a_id, b_id): which with which, and, about that triple, what was done and why."""
    a, b = ids.node_id(F.col("a_id")), ids.node_id(F.col("b_id"))
    rows = pairs.select("a_id", "b_id", ids.triple_id(a, F.lit(SETTLED), b).alias("about"))
    fact = lambda s, p, o: rows.select(F.col(s).alias("s"), F.lit(p).alias("p"), o.alias("o"))
    return fact("a_id", SETTLED, F.col("b_id")).unionByName(fact("about", ACTION, F.lit(action))).unionByName(fact("about", REASONING, F.lit(reasoning)))


def tension_classes(t: DataFrame) -> DataFrame:
    """(subject, predicate, members): keys with several live objects, a row a key and no pairs."""
    live = t.where((F.col("local_weight") > 0) & ~F.col("predicate").isin(*MULTI_VALUED))
    per = live.groupBy("subject", "predicate").agg(F.count("*").alias("members"), F.min("object").alias("lo"), F.max("object").alias("hi"))
    return per.where("lo <> hi").select("subject", "predicate", "members")


# hot and cold tiers


def read_tiers(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Hot rows and the cold rows that have no hot copy."""
    return hot.unionByName(cold.join(hot.select("id"), "id", "left_anti"))


def promotable(cold: DataFrame, hot: DataFrame, policy: str = "access", threshold: int = 3, as_of: Column | None = None, hours: int = 1) -> DataFrame:
    """Cold rows to become hot: all ("immediate"), those read often enough, or often enough within some hours."""
    rows = cold.join(hot.select("id"), "id", "left_anti")
    if policy == "immediate":
        return rows
    rows = rows.where(F.col("access_count") >= threshold)
    if policy == "frequency":
        rows = rows.where(F.col("last_accessed").cast("timestamp") >= as_of.cast("timestamp") - F.expr(f"interval {int(hours)} hours"))
    return rows


#: So many rows at one end of an order are found by a top-k.
FEW = 10_000


def marked(df: DataFrame, order: list[str], n: int, k: int) -> DataFrame:
    """The n rows of df with _first: whether a row is one of the first k in this order (nulls first; the order's columns tell rows apart).

    Only the last of the first k rows is looked for, the rest is one comparison a row: a top-k from the nearer end if that is
    near, or else exact counts of ranges, of which one is opened. No task sees more than a range.
    """
    if not 0 < k < n:
        return df.withColumn("_first", F.lit(k >= n))
    key = F.struct(*order)
    at = df.select(key.alias("_cut"))
    if n - k <= FEW:
        cut = at.orderBy(F.desc("_cut")).limit(n - k).agg(F.min("_cut").alias("_cut"))
        return df.crossJoin(F.broadcast(cut)).withColumn("_first", key < F.col("_cut")).drop("_cut")  # one row
    if k > FEW:
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 1_000_000)
        ranged = at.repartitionByRange(parts, "_cut").groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("c"), F.min("_cut").alias("lo"), F.max("_cut").alias("hi"))
        before = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        here = ranged.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).where((F.col("before") < k) & (F.col("before") + F.col("c") >= k))
        here = settle(here.select("lo", "hi", "before"))
        at, k = at.crossJoin(F.broadcast(here)).where("_cut >= lo and _cut <= hi").select("_cut"), k - here.first().before
    cut = at.orderBy("_cut").limit(k).agg(F.max("_cut").alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("_first", key <= F.col("_cut")).drop("_cut")  # one row


def over_capacity(hot: DataFrame, capacity: int, order: str = "last_accessed") -> DataFrame:
    """The rows that have to leave so that ``capacity`` stay: least recently read first, then by id."""
    n = hot.count()
    return marked(hot, [order, "id"], n, max(0, n - capacity)).where("_first").drop("_first")


def idle(hot: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return hot.where(F.col("last_accessed").cast("timestamp") < as_of.cast("timestamp") - F.expr(f"interval {int(hours)} hours"))
