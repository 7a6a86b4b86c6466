"""Removal of word windows that already occur in an earlier document, by level-wise doubling.

Windows that repeat across documents at one length alone are extended to twice that length, until the target
length is reached or no candidate survives. Below the target length, a window of the target length is
stood for by its least hash among its sub-windows of the level's length (a minimiser), so a level hashes all
positions but passes on a few hundredths of them, and equal windows always choose equal sub-windows: no
repeat is lost. The registered query goes from 13 over 26 to 50 words. Texts that still have a candidate are
written once, so a further level reads those alone. At the target length, neighbouring candidate windows with the same minimiser travel as one
segment. A segment whose whole content also stands in an earlier document is settled at once; only
segments that share a minimiser with a different segment are opened into windows, one representative for
each distinct segment. So thousands of copies cost one aggregation with map-side combine, and no pair of
copies is ever formed.

A window is known by the pair of its minimiser's hash and its own, 128 bits.

Defined cases: null and wordless texts have no words and the digest of the empty string; documents shorter
than a window lose nothing; a null doc_id is neither earlier nor later than any other, so its words stay
and make no others go; rows that share a doc_id count as one document in several parts (parts remove
nothing from each other); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, table, tidy

WINDOW, BASE, LONGEST_SEGMENT = 50, 13, 256
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), 0x94D049BB133111EB, np.uint64(0xBF58476D1CE4E5B9)


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = a * _A + b * np.uint64((_B + 2 * salt) & (2**64 - 1))
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def double(h: np.ndarray, length: int, target: int) -> np.ndarray:
    """Hashes of all windows of a length extended to at most twice that length (two windows that overlap)."""
    shift = target - length
    return _mix(h[: len(h) - shift], h[shift:], target)


def window_hashes(words: np.ndarray, length: int, known: np.ndarray | None = None, known_length: int = 1) -> np.ndarray:
    h, n = (words, 1) if known is None else (known, known_length)
    while n < length and len(h):
        to = min(2 * n, length)
        h, n = double(h, n, to), to
    return h


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum over a width, by doubling."""
    n = 1
    while n < width:
        to = min(2 * n, width)
        h, n = np.minimum(h[: len(h) - (to - n)], h[to - n :]), to
    return h


class Words:
    """Word hashes of texts; remembers a bounded number of words."""

    def __init__(self, remember: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.remember = remember

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest as h

        known = self.known
        if len(known) > self.remember:
            known.clear()
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in set(words).difference(known):
                known[w] = h(w)
            return np.array([known[w] for w in words], np.uint64)


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # bytes split at exactly the six separators


def _level(window: int, length: int, before: int | None):
    """Distinct minimisers of a level in each text; after the first level, of surviving windows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words()
        for b in batches:
            ids, hashes = [], []
            for k in range(b.num_rows):
                words = _words(b.column(1)[k].as_py())
                if len(words) < window:
                    continue
                h = own(words)
                m = least(window_hashes(h, length), window - length + 1)
                if before:
                    alive = np.array(b.column(2)[k].as_py(), np.int64).view(np.uint64)
                    m = m[np.isin(least(window_hashes(h, before), window - before + 1), alive)]
                u = np.unique(m)
                hashes.append(u.view(np.int64))
                ids.append(np.full(len(u), b.column(0)[k].as_py(), np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(hashes))], ["doc_id", "h"])

    return run


def _segments(window: int, length: int):
    """Candidate windows in segments: (doc_id, tag, at, m, s, hs)."""
    names = ["doc_id", "tag", "at", "m", "s", "hs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        own = Words()
        for b in batches:
            out = ([], [], [], [], [], [])
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py()
                words = _words(text)
                if len(words) < window:
                    continue
                h = window_hashes(own(words), length)
                m = least(h, window - length + 1)
                alive = np.array(b.column(2)[k].as_py(), np.int64).view(np.uint64)
                at = np.flatnonzero(np.isin(m, alive))
                if not len(at):
                    continue
                full = window_hashes(h, window, h, length)[at]
                cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (m[at[1:]] != m[at[:-1]])) + 1
                starts = np.concatenate(([0], cut, [len(at)]))
                # long runs of one minimiser (a word again and again) are cut, which costs no repeat
                pieces = [np.arange(i, j, LONGEST_SEGMENT) for i, j in zip(starts[:-1], starts[1:], strict=True)]
                first = np.concatenate(pieces)
                last = np.append(first[1:], len(at))
                raw = full.tobytes()
                out[0].append(np.full(len(first), b.column(0)[k].as_py(), np.int64))
                out[1].append(np.full(len(first), digest(text.encode(), 7) & 0x7FFFFFFF, np.int64))
                out[2].append(at[first])
                out[3].append(m[at[first]].view(np.int64))
                out[4].append(np.fromiter((digest(raw[8 * i : 8 * j]) for i, j in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first)).view(np.int64))
                out[5].append((last - first, full.view(np.int64)))
            if out[0]:
                sizes = np.concatenate([n for n, _ in out[5]])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate([x for _, x in out[5]])))
                flat = [np.concatenate(x) for x in out[:5]]
                yield pa.RecordBatch.from_arrays([pa.array(flat[0]), pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.int32)), pa.array(flat[3]), pa.array(flat[4]), lists], names)

    return run


def _remove(window: int):
    names = ["doc_id", "n_words", "n_removed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        for b in batches:
            out = ([], [], [], [])
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py()
                words, gone = _words(text), 0
                spans = b.column(2)[k].as_py()
                if spans:
                    tag = digest(text.encode(), 7) & 0x7FFFFFFF
                    step = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        if s["tag"] != tag:
                            continue
                        if s["ks"] is None:
                            step[s["at"]] += 1
                            step[s["at"] + s["n"] - 1 + window] -= 1
                        else:
                            for i in s["ks"]:
                                step[s["at"] + i] += 1
                                step[s["at"] + i + window] -= 1
                    covered = np.cumsum(step)[:-1] > 0
                    gone = int(covered.sum())
                    kept = b" ".join([words[i] for i in np.flatnonzero(~covered).tolist()]) if gone else b" ".join(words)
                else:
                    kept = b" ".join(words)
                out[0].append(b.column(0)[k].as_py())
                out[1].append(len(words))
                out[2].append(gone)
                out[3].append(kept.decode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names)

    return run


def repeated_segments(d: DataFrame, window: int, base: int) -> DataFrame:
    """(doc_id, spans): for each document with a repeat, array of (tag, at, n, ks); ks null: all n windows from at on."""
    before, alive, length = None, None, base
    src = d
    while True:
        if alive is not None:
            src = keep(src.select("doc_id", "text").join(alive, "doc_id"))
        if length >= window:
            break
        rows = keep(src.mapInArrow(tidy(_level(window, length, before)), "doc_id long, h long"))
        shared = keep(rows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("h"))
        alive = rows.join(shared, "h").groupBy("doc_id").agg(F.collect_set("h").alias("alive"))
        before, length = length, 2 * length
    segs = keep(src.mapInArrow(tidy(_segments(window, before)), "doc_id long, tag int, at int, m long, s long, hs array<long>"))
    firsts = keep(segs.groupBy("m", "s").agg(F.min("doc_id").alias("d0"), F.first("hs").alias("hs")))
    mixed = firsts.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m")
    opened = keep(firsts.join(mixed, "m").select("m", "s", "d0", F.posexplode("hs").alias("k", "h")))
    # written first, so that the join's sides are plain exchanges and a hot window's rows can be split
    known = keep(opened.groupBy("m", "h").agg(F.min("d0").alias("lo"), F.max("d0").alias("hi")).where("lo < hi").select("m", "h", "lo"))
    hits = opened.join(known, ["m", "h"]).where("d0 > lo").groupBy("m", "s").agg(F.collect_list("k").alias("ks"))
    # each distinct segment's verdict first; then one join with plain exchanges on both sides, so that a hot segment's rows can be split
    told = keep(firsts.select("m", "s", "d0").join(hits, ["m", "s"], "left"))
    found = segs.select("doc_id", "tag", "at", F.size("hs").alias("n"), "m", "s").join(told, ["m", "s"]).where("doc_id > d0 or ks is not null")
    found = keep(found.select("doc_id", F.struct("tag", "at", "n", F.when(F.expr("doc_id = d0"), F.col("ks")).alias("ks")).alias("span")))
    return found.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, base: int = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) a row; kept: the words that stay, joined by one space."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = keep(repeated_segments(d.where("doc_id is not null"), window, base))
    return d.join(spans, "doc_id", "left").mapInArrow(tidy(_remove(window)), "doc_id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW}),
hashed AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM starts),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM hashed) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM hit),
counted AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, p: NOT list_contains(ps, p)), ' ') END) AS kept_sha256
FROM d LEFT JOIN counted c ON d.doc_id = c.doc_id
"""
