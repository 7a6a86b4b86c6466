"""Content-addressed identities: the first 128 bits of SHA-256, in hex. Equal content, equal id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(value: Column) -> Column:
    return F.substring(F.sha2(F.encode(value, "utf-8"), 256), 1, 32)


def triple_id(subject: Column, predicate: Column, obj: Column) -> Column:
    """From the ids of both nodes and the predicate's text."""
    return F.substring(F.sha2(F.concat(F.unhex(subject), F.encode(predicate, "utf-8"), F.unhex(obj)), 256), 1, 32)


def predicate_id(p: Column) -> Column:
    return node_id(F.concat(F.lit("predicate:"), p))


def triple_hash(triple: Column) -> Column:
    return F.sha2(F.unhex(triple), 256)
