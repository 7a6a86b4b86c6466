"""Quality classifier from weak labels: posterior labels train a hashed linear scorer.

Overlapping heuristic labellers vote on every document; expectation-maximisation over the pattern counts of
all documents estimates their accuracies; the posterior probabilities are the soft labels of a logistic
scorer over hashed features (word shapes, pairs of shapes, and bucketed format counts of the whole text).
The scorer is fitted on a bounded sample of distinct texts, drawn by their hash (a documented parameter,
``SAMPLE``: about so many good ones and half as many suspects are expected; equal texts are one, so no group
of copies can fill it); labeller statistics and scores cover all documents. It judges by the words' form
where labellers abstain.

Defined cases: a posterior of exactly a half counts as good, a score of exactly ``KEEP_AT`` is kept; a null or wordless text has only the feature of being empty and is scored by it, never kept;
repeated rows get equal scores; an empty table gives an empty result; other columns are ignored by
``score`` and returned untouched by ``filter_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, table, tidy
from .quality_rules import counted, measured, pattern_posteriors
from .textstats import NAMES, stats

BITS, SAMPLE, KEEP_AT = 11, 4000, 0.5
_KIND = str.maketrans({c: "a" for c in "abcdefghijklmnopqrstuvwxyz"} | {c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: "0" for c in "0123456789"})
_RUN = re.compile(r"(.)\1+", re.S)


def _slot(token: str, bits: int) -> int:
    from xxhash import xxh32_intdigest

    return xxh32_intdigest(token) & ((1 << bits) - 1)


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each; other letters are small or capital; symbols stay, doubled ones as two."""
    s = word.translate(_KIND)
    if not s.isascii():
        s = "".join(("A" if c.isupper() else "a") if c.isalpha() else c if c.isascii() else "?" for c in s)
    return _RUN.sub(lambda m: m[1] if m[1] in "aA0" else m[1] * 2, s)


class Features:
    """Hashed features of a text; each shape goes straight to its slot, so a text's features are its own, whatever was read before it.

    The hashes of words are remembered up to a bound, then forgotten: that saves time only.
    """

    def __init__(self, bits: int = BITS, remember: int = 100_000):
        self.bits, self.remember, self.hashes, self.slots = bits, remember, {}, {}

    def _word(self, w: str) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(shape(w))
        if len(w) <= 64:  # longer ones are seldom met again
            if len(self.hashes) >= self.remember:
                self.hashes.clear()
            self.hashes[w] = h
        return h

    def _named(self, token: str) -> int:
        k = self.slots.get(token)
        if k is None:
            k = self.slots[token] = _slot(token, self.bits)
        return k

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(slots, values), each slot once."""
        words = re.split(r"[\x20\t\n\x0b\x0c\r]+", text or "")
        words = [w for w in words if w]
        n = len(words)
        if not n:
            return np.array([self._named("empty")]), np.array([1.0], np.float32)
        get, own = self.hashes.get, self._word
        h = np.fromiter((own(x) if (i := get(x)) is None else i for x in words), np.uint64, n)
        two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        two = (two ^ (two >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        two ^= two >> np.uint64(32)
        mask = np.uint64((1 << self.bits) - 1)
        # whole counts are summed before the division, so the order of words can't show in the last digits
        values = np.bincount((np.concatenate((h, two)) & mask).astype(np.int64), minlength=1 << self.bits) / n
        s = dict(zip(NAMES, stats(text), strict=True))
        ratios = {"sym": s["n_symbols"] / n, "up": s["n_upper"] / max(s["n_letters"], 1), "rep": s["n_repeat_words"] / n, "same": s["n_same"] / n, "dup": s["n_dup_lines"] / max(s["n_lines"], 1), "ends": s["n_ends"] / n, "voc": s["n_distinct"] / n**0.5 / 10, "bars": s["n_bars"] / n}
        for k, x in ratios.items():
            values[self._named(f"3{k}{min(int(10 * x), 10)}")] += 0.5
        values[self._named("bias")] += 1.0
        u = np.flatnonzero(values)
        return u, values[u].astype(np.float32)


def fit_scorer(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300, l2: float = 1e-4, rate: float = 0.2) -> np.ndarray:
    """Logistic weights for soft labels by full-batch Adam; deterministic."""
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    x = np.ascontiguousarray(x, np.float32)
    share = weight / max(weight.sum(), 1e-9)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = (share * (p - y)).astype(np.float32) @ x + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Weights of the scorer, labellers' statistics from all documents, weights from a bounded sample."""
    m = keep(measured(docs).select("votes"))
    patterns = {r.votes: (r["count"], p) for r, p in pattern_posteriors(m)}
    total, bad = sum(c for c, _ in patterns.values()), sum(c for c, p in patterns.values() if p < 0.5)
    if not total:
        return np.zeros(1 << bits)
    # as many suspects as others where there are enough: each class is drawn at a rate of its own
    rates = (min(1.0, sample / total), min(1.0, sample / max(2 * bad, 1)))
    draw = F.pmod(F.xxhash64(F.col("text"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    good = {v: p for v, (_, p) in patterns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(bits)
        for b in batches:
            out = ([], [], [], [])
            texts = b.column(1).to_pylist()
            for key, text, u, v in zip(b.column(0).to_pylist(), texts, b.column(2).to_pylist(), counted(texts)[1], strict=True):
                p = good[v]
                if u < rates[p < 0.5]:
                    for o, x in zip(out, (key, p, *f(text)), strict=True):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float32())), strict=True)], ["key", "p_good", "slots", "vals"])

    drawn = docs.select(F.xxhash64("text").alias("key"), "text", draw.alias("u")).where(F.col("u") < max(rates))
    made = drawn.mapInArrow(tidy(run), "key long, p_good double, slots array<int>, vals array<float>")
    rows = made.groupBy("key").agg(F.first("p_good").alias("p_good"), F.first("slots").alias("slots"), F.first("vals").alias("vals")).orderBy("key").collect()  # distinct texts at the rates above
    if not rows:
        return np.zeros(1 << bits)
    x, y = np.zeros((len(rows), 1 << bits), np.float32), np.zeros(len(rows))
    for i, r in enumerate(rows):
        x[i, r.slots] = r.vals
        y[i] = r.p_good
    few = (y < 0.5).mean()
    weight = np.where(y < 0.5, min(3.0, 0.3 / max(few, 1e-3)), 1.0)
    return fit_scorer(x, y, weight)


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """(doc_id, score, kept) a row."""
    w = np.asarray(weights, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(bits)
        for b in batches:
            s, k = [], []
            for x in b.column(1):
                text = x.as_py()
                at, v = f(text)
                p = 1 / (1 + np.exp(-np.clip(float(w[at] @ v), -30, 30)))
                s.append(p)
                k.append(bool(p >= KEEP_AT and text and text.split() != []))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(k, pa.bool_())], ["doc_id", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double, kept boolean")


def filter_documents(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """The input rows that the scorer keeps, with all their columns, in one pass and without a join."""
    w, at_text, schema = np.asarray(weights, np.float64), docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(bits)
        for b in batches:
            k = []
            for x in b.column(at_text):
                text = x.as_py()
                at, v = f(text)
                k.append(bool(float(w[at] @ v) >= 0 and text and text.split() != []))
            yield b.filter(pa.array(k, pa.bool_()))

    return docs.mapInArrow(tidy(run), schema)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))
