"""Weights over time: decay, eviction, bounds, co-access mining, feedback, blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scores
from graphloom.operators import store


def check_factor(factor: float, least: float = 0.0) -> None:
    if not 0 <= factor <= 1 or least < 0:
        raise ValueError("a decay factor is between 0 and 1 and a least weight is not negative")


def decay(t: DataFrame, factor: float, floor: float | None = None) -> DataFrame:
    """Local weights times factor; with a floor, only those at it or above it, and never below it."""
    check_factor(factor, floor or 0.0)
    w = F.col("local_weight")
    new = w * factor if floor is None else F.when(w >= floor, F.greatest(w * factor, F.lit(floor))).otherwise(w)
    return t.withColumn("local_weight", new)


def protected_decay(t: DataFrame, factor: float, protection: Column) -> DataFrame:
    """Decay weakened by protection in [0, 1], such as centrality or provenance."""
    return t.withColumn("local_weight", F.col("local_weight") * (1 - (1 - factor) * (1 - protection)))


def evict(t: DataFrame, threshold: float) -> DataFrame:
    return t.where(F.col("local_weight") >= threshold)


def cycle(t: DataFrame, factor: float = 0.95, least: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Decay, then eviction: (new version, one row of counts and total weights before and after)."""
    new = evict(decay(t, factor), least)
    total = lambda df, p: df.agg(F.count("*").alias(f"{p}_count"), F.round(F.sum("local_weight"), 4).alias(f"{p}_weight"))
    return new, total(t, "before").crossJoin(total(new, "after"))  # one row each


def utilisation(n_triples: int, n_nodes: int, max_triples: int = 10_000, max_nodes: int = 5_000) -> float:
    return max(n_triples / max_triples, n_nodes / max_nodes)


def enforce(t: DataFrame, max_triples: int, target: float = 0.8, max_nodes: int | None = None) -> DataFrame:
    """The lightest triples go until the target share of the bound is left; ties by id. The heaviest that goes is looked for, and every row is held against it.

    Where triples are within their target but nodes (ends of subject and object) are not, half as many triples go as there are nodes too many.
    """
    n, goal = t.count(), int(max_triples * target)
    over = max(0, n - goal)
    if not over and max_nodes is not None:
        nodes = t.select(F.col("subject").alias("n")).union(t.select("object")).distinct().count()
        over = max(0, nodes - int(max_nodes * target)) // 2
    if not over:
        return t
    return store.marked(t, ["local_weight", "id"], n, over).where("not _first").drop("_first")


# co-access


def contexts(log: DataFrame) -> DataFrame:
    """(context, refs, ts): what each context read, each thing once."""
    return log.groupBy("context").agg(F.array_sort(F.collect_set("ref")).alias("refs"), F.max("ts").alias("ts"))


def pair_counts(ctx: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, n): how many contexts read both, a < b."""
    a = ctx.select("context", "refs", F.posexplode("refs").alias("i", "a"))
    pairs = a.select("a", F.explode(F.slice("refs", F.col("i") + 2, F.size("refs"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def last_contexts(ctx: DataFrame, n: int) -> DataFrame:
    """The newest n contexts: a window that slides by count."""
    return ctx.orderBy(F.desc("ts"), F.desc("context")).limit(n)


def unexpired(ctx: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return ctx.where(F.col("ts").cast("timestamp") >= as_of.cast("timestamp") - F.expr(f"interval {int(hours)} hours"))


def reinforce(pairs: DataFrame, facts: DataFrame, existing: DataFrame) -> DataFrame:
    """(src, dst): new links between the subjects, and between the objects, of facts (ref, src, dst) read together, unless linked in either direction."""
    a, b = facts.toDF("a", "as", "ao"), facts.toDF("b", "bs", "bo")
    met = pairs.join(a, "a").join(b, "b")
    ends = met.select(F.explode(F.array(F.struct(F.col("as").alias("x"), F.col("bs").alias("y")), F.struct(F.col("ao").alias("x"), F.col("bo").alias("y")))).alias("e")).select("e.x", "e.y").where("x <> y")
    new = ends.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct()
    old = existing.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return new.join(old, ["src", "dst"], "left_anti")


def insert_rates(events: DataFrame, seconds: int = 10) -> DataFrame:
    """(start, n, rate, strategy): events a tumbling window, and the embedding strategy such a rate calls for."""
    w = events.groupBy(F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    rate = F.col("n") / F.lit(float(seconds))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", rate.alias("rate"), strategy(rate).alias("strategy"))


#: Seconds between two recomputations of a strategy.
COOLDOWN = {"node2vec": 60, "spectral": 300}


def recomputed(rates: DataFrame, name: str, cooldown: int | None = None) -> DataFrame:
    """The windows (start, rate) in which a strategy's vectors are computed anew: the rate calls for it and the last time is long enough ago.

    Which window is the next depends on the one before, so each stretch of windows that are close together is folded in order; a
    pause as long as the cooldown begins a new stretch, and stretches are worked on apart.
    """
    wait = COOLDOWN[name] if cooldown is None else cooldown
    least = {"node2vec": 10, "spectral": 100}[name]
    at = F.unix_timestamp(F.col("start").cast("timestamp"))
    due = rates.where((F.col("rate") >= least) & (F.col("rate") < 500)).select("start", at.alias("at"))
    place = Window.orderBy("at")  # a row a window of time, not an event
    due = due.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(place) >= wait).cast("int"), F.lit(1))).withColumn("stretch", F.sum("new").over(place))
    per = due.groupBy("stretch").agg(F.array_sort(F.collect_list(F.struct("at", "start"))).alias("xs"))
    ran = F.expr(f"aggregate(xs, named_struct('last', -{wait}L, 'out', filter(xs, x -> false)), (a, x) -> if(x.at - a.last >= {wait}, named_struct('last', x.at, 'out', array_append(a.out, x)), a), a -> a.out)")
    return per.select(F.explode(ran).alias("x")).select("x.start")


def strategy(rate: Column) -> Column:
    """Inserts a second above which a cheaper way is taken."""
    return F.when(rate >= 500, "backpressure").when(rate >= 100, "spectral").when(rate >= 10, "node2vec").otherwise("spring")


# feedback


def feedback_counts(log: DataFrame) -> DataFrame:
    return log.where("signal is not null").groupBy("ref", "signal").agg(F.count("*").alias("n"))


def recent_quality(log: DataFrame, n: int) -> DataFrame:
    """Mean value of the newest n events, nulls among them not replaced."""
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).agg(F.round(F.avg("value"), 6).alias("quality"))


def trimmed(log: DataFrame, capacity: int) -> DataFrame:
    """A history over capacity loses its oldest tenth."""
    n = log.count()
    if n <= capacity:
        return log
    old = log.orderBy("ts", "event_id").limit(max(1, capacity // 10)).select("event_id")
    return log.join(old, "event_id", "left_anti")


def apply_feedback(weights: DataFrame, log: DataFrame, mode: str = "multiplicative") -> DataFrame:
    """(ref, old_weight, new_weight, reads): signals of each ref in order of event, one clamped step each."""
    steps = log.where("signal is not null").groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("event_id", "signal"))).alias("xs"))
    folded = F.aggregate("xs", F.col("weight"), lambda w, x: scores.adjusted(w, x["signal"], mode))
    reads = F.size(F.filter("xs", lambda x: x["signal"].isin("cited", "relevant")))
    return weights.join(steps, "ref").select("ref", F.col("weight").alias("old_weight"), folded.alias("new_weight"), reads.alias("reads"))


def feedback_of(log: DataFrame, context: str | None = None, ref=None) -> DataFrame:
    """Feedback of a context, or about a fact."""
    for name, value in (("context", context), ("ref", ref)):
        if value is not None:
            log = log.where(F.col(name) == value)
    return log.where("signal is not null")


def positive_events(log: DataFrame) -> DataFrame:
    """(context, refs, ts): what each context's feedback found useful, as one co-access event."""
    return contexts(log.where(F.col("signal").isin("cited", "relevant")))


def blend_step(attributions: DataFrame, rate: float = 0.01) -> DataFrame:
    """Per context, each strategy's reward-weighted share: (context, d_spring, d_node2vec, d_spectral), from (context, signal, spring, node2vec, spectral)."""
    r = scores.mapped(scores.REWARDS, F.col("signal"))
    names = ("spring", "node2vec", "spectral")
    total = sum(F.coalesce(F.abs(F.col(c)), F.lit(0.0)) for c in names)
    sums = attributions.where("signal is not null").groupBy("context").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0.0)) * r).alias(c) for c in names], F.sum(total).alias("total"))
    return sums.where("total > 0").select("context", *[(F.col(c) / F.col("total")).alias(f"d_{c}") for c in names])


def blended(weights: tuple[float, float, float], deltas: tuple[float, float, float], rate: float = 0.01, least: float = 0.05) -> tuple[float, float, float]:
    """Blend weights after one context: moved, floored, normalised, what a floor needs taken from the largest."""
    w = [max(a + rate * d, least) for a, d in zip(weights, deltas, strict=True)]
    total = sum(w)
    w = [x / total for x in w] if total > 0 else [1 / 3] * 3
    for i, was in enumerate(list(w)):
        if was < least:
            w[i] = least
            w[max(range(3), key=lambda j: (w[j], -j))] -= least - was
    return tuple(w)


# sessions


def sessions(conv: DataFrame) -> DataFrame:
    """(session_id, n_exchanges, n_user, first_turn, last_turn, status): a conversation's summary; it has ended if the assistant spoke last."""
    last = F.max(F.struct("turn", "role"))
    s = conv.groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("n_exchanges"), F.count(F.when(F.col("role") == "user", 1)).alias("n_user"), F.min("turn").alias("first_turn"), last.alias("x"))
    return s.select("session_id", "n_exchanges", "n_user", "first_turn", F.col("x.turn").alias("last_turn"), F.when(F.col("x.role") == "assistant", "ended").otherwise("active").alias("status"))


def list_sessions(s: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    rows = s if status is None else s.where(F.col("status") == status)
    return rows.orderBy(F.desc("last_turn"), F.desc("session_id")).limit(limit)


def exchanges(conv: DataFrame, session_id: int, limit: int, offset: int = 0) -> DataFrame:
    return conv.where(F.col("conv_id") == session_id).orderBy("turn").offset(offset).limit(limit)


def end_session(s: DataFrame, session_id: int, summary: str | None = None) -> DataFrame:
    hit = F.col("session_id") == session_id
    return s.withColumn("status", F.when(hit, "ended").otherwise(F.col("status"))).withColumn("summary", F.when(hit, F.lit(summary)))


def create_patterns(rows: DataFrame) -> DataFrame:
    """New patterns start emerging, at 0.4."""
    return rows.withColumn("confidence", F.lit(0.4)).withColumn("status", F.lit("emerging"))


def reinforce_patterns(p: DataFrame, evidence: DataFrame) -> DataFrame:
    """Patterns (id, confidence, status, sessions) with new evidence (id, session): 0.1 more for each, established from 0.7."""
    new = evidence.groupBy("id").agg(F.array_sort(F.collect_set("session")).alias("more"), F.count("*").alias("times"))
    rows = p.join(new, "id", "left")
    conf = F.when(F.col("times").isNotNull(), F.least(F.round(F.col("confidence") + 0.1 * F.col("times"), 9), F.lit(1.0))).otherwise(F.col("confidence"))
    rows = rows.withColumn("confidence", conf).withColumn("sessions", F.array_sort(F.array_union("sessions", F.coalesce("more", F.array().cast("array<bigint>")))))
    return rows.withColumn("status", F.when((F.col("status") == "emerging") & (F.col("confidence") >= 0.7), "established").otherwise(F.col("status"))).drop("more", "times")


def decay_patterns(p: DataFrame, factor: float = 0.95) -> DataFrame:
    live = F.col("status") != "archived"
    c = F.when(live, F.col("confidence") * factor).otherwise(F.col("confidence"))
    return p.withColumn("confidence", c).withColumn("status", F.when(live & (F.col("confidence") < 0.1), "archived").when(live & (F.col("confidence") < 0.2), "fading").otherwise(F.col("status")))


def search_patterns(p: DataFrame, part: str, limit: int, least: float | None = None, status: str | None = None, kind: str | None = None) -> DataFrame:
    """Patterns whose description holds part, of a status and type where given; least confidence is asked for after the limit."""
    for name, value in (("status", status), ("type", kind)):
        if value is not None:
            p = p.where(F.col(name) == value)
    rows = p.where(F.contains(F.lower("description"), F.lit(part.lower()))).orderBy(F.desc("confidence"), "id").limit(limit)
    return rows if least is None else rows.where(F.col("confidence") >= least)


def rank_in(df: DataFrame, by: str, key: str, group: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), key)))
