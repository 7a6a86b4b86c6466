"""Reconciling two graphs, and importing documents as beliefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import ids


def retracted(t: DataFrame, facts: DataFrame) -> DataFrame:
    """Triples that a fact (s, p, o) retracts."""
    gone = facts.where("p = 'retracted_by'").select(F.col("s").alias("id")).distinct()
    return t.join(gone, "id", "left_semi")


def shareable(t: DataFrame, facts: DataFrame, recipient: str | None) -> DataFrame:
    """Triples (id, s, p, o) that may go to a recipient: retractions always, subjects kept local never, listed ones to those listed."""
    local = facts.where("p = 'local_only'").select("s").distinct()
    listed = facts.where("p = 'shareable_with'").groupBy("s").agg(F.max(F.coalesce(F.col("o") == F.lit(recipient), F.lit(False)).cast("int")).alias("_for"))
    always = t.where("p in ('retracted_by', 'retracted_at')")
    rest = t.where("p not in ('retracted_by', 'retracted_at')").join(local, "s", "left_anti").join(listed, "s", "left")
    return always.unionByName(rest.where("_for is null or _for = 1").select(t.columns))


def collected(t: DataFrame, wanted_ids: DataFrame, facts: DataFrame, recipient: str | None) -> DataFrame:
    """The triples asked for by id, of those that may go to the recipient."""
    return shareable(t.join(wanted_ids.select("id").distinct(), "id", "left_semi"), facts, recipient)


def missing(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """My triples that the peer lacks; exact, by id."""
    return mine.join(theirs.select("id"), "id", "left_anti")


def headers(t: DataFrame, wanted: DataFrame) -> DataFrame:
    """Triples with the hashes asked for. Hashes (lower-case hex, anything else matches nothing) travel as bytes, and a triple's is made again where it ends."""
    asked = wanted.select(F.unhex("hash").alias("_key"), "hash").where(F.lower(F.hex("_key")) == F.col("hash")).select("_key")
    found = t.withColumn("_key", F.unhex(ids.triple_hash(F.col("id")))).join(asked, "_key", "left_semi").drop("_key")
    return found.select(ids.triple_hash(F.col("id")).alias("hash"), *t.columns)


def wanted(offered: DataFrame, mine: DataFrame, facts: DataFrame) -> DataFrame:
    gone = facts.where("p = 'retracted_by'").select(F.col("s").alias("id")).distinct()
    return missing(offered, mine).join(gone, "id", "left_anti")


#: Corroboration step, and the least weight of what strangers say.
STEP, LEAST = 0.05, 0.1


def merge(mine: DataFrame, received: DataFrame, facts: DataFrame, trust: DataFrame | None = None) -> DataFrame:
    """(id, s, p, o, base_weight, local_weight) after receiving (id, s, p, o, origin_did): what fails its content hash or is retracted is dropped;
    known triples gain, new ones weigh by the rank of who says so (trust: origin_did, rank), retractions fully."""
    a, b = ids.node_id(F.col("s")), ids.node_id(F.col("o"))
    true = received.where(F.col("id") == ids.triple_id(a, F.col("p"), b)).dropDuplicates(["id"])
    gone = facts.where("p = 'retracted_by'").select(F.col("s").alias("id")).distinct()
    true = true.join(gone, "id", "left_anti")
    again = true.select("id").withColumn("_again", F.lit(1))
    kept = mine.join(again, "id", "left").withColumn("base_weight", F.when(F.col("_again").isNotNull(), F.least(F.col("base_weight") + STEP, F.lit(1.0))).otherwise(F.col("base_weight"))).drop("_again")
    new = true.join(mine.select("id"), "id", "left_anti")
    if trust is not None:
        n = trust.count()
        new = new.join(trust.select("origin_did", "rank"), "origin_did", "left")
        base = F.least(F.greatest(F.coalesce(F.col("rank") * n, F.lit(LEAST)), F.lit(LEAST)), F.lit(1.0))
    else:
        base = F.lit(LEAST)
    base = F.when(F.col("p").isin("retracted_by", "retracted_at"), 1.0).otherwise(base)
    return kept.select("id", "s", "p", "o", "base_weight", "local_weight").unionByName(new.select("id", "s", "p", "o", base.alias("base_weight"), F.lit(0.0).alias("local_weight")))


def peers_to_sync(peers: DataFrame) -> DataFrame:
    """Connected peers past the first phase of trust (0 unknown, 1 provisional, 2 trusted, 3 inner)."""
    return peers.where("connected and trust_phase >= 1")


def truncated(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


#: Predicate of an entity's role.
ROLES = {"subject": "about", "object": "mentions", "context": "in_context", "source": "from_source"}


def beliefs(rows: DataFrame) -> DataFrame:
    """Facts (s, p, o) of beliefs (id, content, path array, entities array of (id, name, type, role)): content, provenance, domain chain, entities."""
    node = F.concat(F.lit("belief:"), F.col("id").cast("string"))
    base = rows.select(node.alias("b"), "content", "path", "entities")
    fact = lambda df, s, p, o: df.select(s.alias("s"), p.alias("p"), o.alias("o"))
    domain = lambda n: F.concat(F.lit("domain:"), F.array_join(F.slice("path", 1, n), "/"))
    seg = base.where("size(path) > 0").select("b", "path", F.posexplode("path").alias("i", "segment"))
    ent = base.select("b", F.explode("entities").alias("e"))
    e_node = F.concat(F.lit("entity:"), F.col("e.type"), F.lit(":"), F.col("e.id").cast("string"))
    role = None
    for k, v in ROLES.items():
        role = F.when(F.col("e.role") == k, v) if role is None else role.when(F.col("e.role") == k, v)
    parts = [
        fact(base, F.col("b"), F.lit("has_content"), truncated(F.col("content"))),
        fact(base, F.col("b"), F.lit("has_provenance"), F.lit("v1_migration")),
        fact(seg.where("i = size(path) - 1"), F.col("b"), F.lit("belongs_to_domain"), domain(F.col("i") + 1)),
        fact(seg, domain(F.col("i") + 1), F.lit("domain_label"), F.col("segment")),
        fact(seg.where("i > 0"), domain(F.col("i") + 1), F.lit("subdomain_of"), domain(F.col("i"))),
        fact(ent, e_node, F.lit("entity_name"), F.col("e.name")),
        fact(ent, F.col("b"), role.otherwise("related_to"), e_node),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
