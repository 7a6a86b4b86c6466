"""Toxicity by a gap-weighted subsequence string kernel, Nyström landmarks and an SVM trained on labelled sentences.

A text is cut into sentences (a word that ends in . ! or ? closes one, and so do ``WORDS`` words). A sentence's strings
are its words, its runs of neighbouring words of fewer than four letters taken as one string over their borders, and
runs of three or more single characters spelled out with spaces between; of each only the letters and digits count.
So "i-d-i-o-t" and "i d i o t" are "idiot", and "go die now" is one string. The kernel of two strings sums, over common
subsequences of four letters inside a span of eight, decay to the power of both gaps, so "idixot" keeps most of its
likeness. It is scaled by what strings of their lengths could reach.

Landmarks are strings of the training texts, chosen by evidence and for being unlike each other. A string's kernel
values at the landmarks, whitened by the landmarks' own kernel matrix (Nyström), are the features of a linear SVM
with squared hinge loss. Labels belong to documents, so the SVM is trained on sentences as bags of strings: a sentence
is as toxic as its strongest string, its witness. It starts from strings that toxic documents hold far more often, with
inserted-character spellings of each. Then, ``ROUNDS`` times, every training document gives its three strongest
sentences: witnesses of toxic documents that the SVM finds toxic are positive, those of clean documents are negative,
and it is fitted again. A document's probability comes from its three strongest strings, whose values count up to just
beyond the SVM's margin so that rare insults weigh as much as common ones, from its number of toxic strings and its
length, by a logistic fit on the labelled documents (Platt).

Training uses at most about ``sample`` distinct labelled documents (drawn by hash, documented bound ``SAMPLE``) whose
crc32 of the doc_id is not 1 modulo 3, the ``STRONG`` best of their strings as first positives and ``NEGATIVES`` as first
negatives; all documents are scored over their whole texts. A single word of fewer than four letters between longer
ones has kernel zero and is not seen.

Defined cases: a null or empty text has no sentence and gets the score of a text without evidence; labels that
are null are not used, of several labels the highest is; of several texts under one labelled doc_id one is trained on,
the least by hash; repeated rows get equal scores; a null doc_id is scored (not held out); without usable labels of
both classes every score is the share of toxic labels, or 0; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, table, tidy

ORDER, SPAN, DECAY, SAMPLE, LANDMARKS, CUT, HIGHEST = 4, 8, 0.8, 6000, 128, 0.7, 1.1
LIKELY = 0.5
STRONG, NEGATIVES, ROUNDS, WORDS = 400, 12_000, 2, 24
#: Offsets of a subsequence's letters from its first, inside the span, and the weight of their gaps.
_STEPS = [(c, DECAY ** (c[-1] - (ORDER - 1))) for c in itertools.combinations(range(1, SPAN), ORDER - 1)]
_SPELLED = re.compile(r"(?<!\S)\S(?:[\x20\t]+\S){2,}(?!\S)")
_OTHER = re.compile(r"[\W_]+")
_ASCII = np.zeros(65536, np.int32)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
    _ASCII[ord(_c)] = _i + 1
for _i in range(0xAA, 65536):
    if chr(_i).isalpha():
        _ASCII[_i] = 37 + (_i * 7 + _i // 64) % 27
del _i, _c
_STOPS = frozenset(".!?")


def units(text: str | None) -> tuple[list[str], np.ndarray]:
    """Strings of a whole text in small letters, and the sentence of each. Spelled-out runs are sentences of their own."""
    t = (text or "").lower()
    words = t.split()
    if not words:
        return [], np.zeros(0, np.int64)
    n = len(words)
    first = np.zeros(n, bool)
    first[0] = True
    first[1:] = [w[-1] in _STOPS for w in words[:-1]]
    starts = np.flatnonzero(first)
    first |= (np.arange(n) - starts[np.cumsum(first) - 1]) % WORDS == 0
    sentence = np.cumsum(first) - 1
    out, at = words, sentence
    short = np.fromiter(map(len, words), np.int64, n) < ORDER
    if short.any():
        # neighbours that are both short, in one sentence
        link = np.zeros(n + 1, bool)
        link[1:n] = short[1:] & short[:-1] & ~first[1:]
        begin = np.flatnonzero(~link[:-1] & link[1:])
        end = np.flatnonzero(link[:-1] & ~link[1:]) + 1
        if len(begin):
            out = words + ["".join(words[i:j]) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
            at = np.concatenate((sentence, sentence[begin]))
    spelled = _SPELLED.findall(t)
    if spelled:
        out = out + spelled
        at = np.concatenate((at, sentence[-1] + 1 + np.arange(len(spelled))))
    return out, at


def letters(unit: str) -> str:
    """The letters and digits of a string."""
    return unit if unit.isalnum() else _OTHER.sub("", unit)


def _scale(n: np.ndarray) -> np.ndarray:
    """Square root of the kernel of a string with itself, were its letters all different, by length."""
    n = np.asarray(n, float)
    return np.sqrt(np.maximum(sum(np.maximum(0, n - c[-1]) * w * w for c, w in _STEPS), 1.0))


class Wanted:
    """Lookups for a sorted set of grams: by first letter, first two, and all four."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.flag, self.first, self.second = np.zeros(1 << 24, bool), np.zeros(64, bool), np.zeros(1 << 12, bool)
        self.flag[grams] = True
        self.first[grams >> 18] = True
        self.second[grams >> 12] = True

    def __reduce__(self):
        return Wanted, (self.grams,)


def grams(strings: list[str], wanted: Wanted | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, gram, weight) of every subsequence; with wanted, of those only."""
    if not strings:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    joined = "".join(strings)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = _ASCII[np.minimum(raw, 65535)]
    owner = np.repeat(np.arange(len(strings)), sizes).astype(np.int32)
    starts = np.flatnonzero(wanted.first[codes] if wanted is not None else codes > 0)
    padded = np.concatenate((codes, np.zeros(SPAN, np.int32)))
    own = np.concatenate((owner, np.full(SPAN, -1, np.int32)))
    u, g, w = [], [], []
    head = {}
    for c, weight in _STEPS:
        if c[0] not in head:
            head.clear()
            two = (padded[starts] << 6) | padded[starts + c[0]]
            ok = (padded[starts + c[0]] > 0) & (own[starts + c[0]] == own[starts])
            if wanted is not None:
                ok &= wanted.second[two]
            head[c[0]] = (starts[ok], two[ok])
        s, two = head[c[0]]
        b, d = padded[s + c[1]], padded[s + c[2]]
        code = (two << 12) | (b << 6) | d
        ok = (b > 0) & (d > 0) & (own[s + c[2]] == own[s])
        if wanted is not None:
            ok &= wanted.flag[code]
        u.append(own[s[ok]])
        g.append(code[ok])
        w.append(np.full(int(ok.sum()), weight, np.float32))
    return np.concatenate(u).astype(np.int64), np.concatenate(g), np.concatenate(w)


class Landmarks:
    """Kernel values of units at the landmarks."""

    def __init__(self, names: list[str]):
        self.names = names
        u, g, w = grams(names)
        self.wanted = Wanted(np.unique(g))
        self.table = np.zeros((len(self.wanted.grams), len(names)), np.float32)
        np.add.at(self.table, (np.searchsorted(self.wanted.grams, g), u), w)
        self.table /= self._size(names)[None, :]

    @staticmethod
    def _size(names: list[str]) -> np.ndarray:
        return _scale(np.fromiter(map(len, names), np.int64, len(names)))

    def kernel(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, values): the units with a kernel above zero and their values."""
        u, g, w = grams(strings, self.wanted)
        if not len(u):
            return np.zeros(0, np.int64), np.zeros((0, len(self.names)))
        order = np.argsort(u, kind="stable")
        u, g, w = u[order], g[order], w[order]
        cut = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        at = np.searchsorted(self.wanted.grams, g)
        rows, values = u[cut], np.zeros((len(cut), len(self.names)))
        ends = np.append(cut[1:], len(u))
        for i in range(0, len(cut), 20_000):  # bounded memory
            a, z = cut[i], ends[min(i + 20_000, len(cut)) - 1]
            values[i : i + 20_000] = np.add.reduceat(self.table[at[a:z]] * w[a:z, None], cut[i : i + 20_000] - a)
        lengths = np.fromiter((len(strings[i]) for i in rows.tolist()), np.int64, len(rows))
        return rows, values / _scale(lengths)[:, None]

    def weighed(self, strings: list[str], worth: np.ndarray) -> np.ndarray:
        """Kernel values times a weight a landmark, summed over landmarks: linear, so each gram has one worth (table @ weights)."""
        u, g, w = grams(strings, self.wanted)
        sums = np.bincount(u, w * worth[np.searchsorted(self.wanted.grams, g)], len(strings)) if len(u) else np.zeros(len(strings))
        return sums / self._size(strings)


def spellings(word: str) -> list[str]:
    """Gapped and inserted-character forms of a unit."""
    n = len(word)
    mid = n // 2
    return [word[:mid] + "x" + word[mid:], word[: mid + 1] + word[mid:], word[:2] + "e" + word[2:], word[: n - 1] + "q" + word[n - 1 :], word + "s", "x" + word]


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Primal squared-hinge SVM by Newton steps on the active set; y is 1 or -1."""
    a = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(a.shape[1])
    ridge = np.ones(a.shape[1])
    ridge[-1] = 1e-3
    value = lambda w: 0.5 * (ridge * w * w).sum() + (cost * np.maximum(0, 1 - y * (a @ w)) ** 2).sum()
    for _ in range(rounds):
        act = y * (a @ w) < 1
        b, c, t = a[act], cost[act], y[act]
        grad = ridge * w + 2 * b.T @ (c * (b @ w - t))
        if np.abs(grad).max() < 1e-6:
            break
        step = np.linalg.solve(np.diag(ridge) + 2 * (b.T * c) @ b, -grad)
        size, now = 1.0, value(w)
        while size > 1e-4 and value(w + size * step) > now:
            size /= 2
        w = w + size * step
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1e-2) -> np.ndarray:
    """Weights and, last, the bias of a logistic fit with Platt's softened targets. The witnesses share one weight, so one alone counts."""
    z, sign = np.stack((x[:, :3].sum(1), x[:, 3], x[:, 4]), 1), np.array([1, -1, 1])
    use = [0, 1, 2]
    while True:
        p = _logistic(z[:, use], y, rounds, ridge)
        right = [c for c, w in zip(use, p, strict=False) if w * sign[c] >= 0]  # more evidence never lowers a score, a longer text never raises it
        if right == use:
            w = np.zeros(3)
            w[use] = p[:-1]
            return np.array([w[0], w[0], w[0], w[1], w[2], p[-1]])
        use = right


def _flat(bias: float) -> np.ndarray:
    """A score that no evidence changes."""
    return np.array([0, 0, 0, 0, 0, bias])


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int, ridge: float) -> np.ndarray:
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.hstack((x, np.ones((len(x), 1))))
    p, hold = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    hold[-1, -1] = 1e-6
    loss = lambda p: np.logaddexp(0, z @ p).sum() - t @ (z @ p) + 0.5 * p @ hold @ p
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(z @ p, -30, 30)))
        d = np.linalg.solve((z.T * (q * (1 - q) + 1e-9)) @ z + hold, z.T @ (t - q) - hold @ p)
        size, now = 1.0, loss(p)
        while size > 1e-6 and loss(p + size * d) > now:
            size /= 2
        p = p + size * d
        if np.abs(size * d).max() < 1e-9:
            break
    return p


class Model:
    #: Units whose values are remembered; a bound on memory, not on what is scored.
    REMEMBER = 400_000

    def __init__(self, landmarks: Landmarks | None, beta: np.ndarray | None, bias: float, last: np.ndarray):
        self.landmarks, self.bias, self.last = landmarks, bias, last
        self.worth = None if landmarks is None else landmarks.table @ beta
        self.low = max(min(bias, -1.0), -2.0)
        self.known: dict[str, float] = {}

    def __reduce__(self):
        return _restored, (self.landmarks, self.bias, self.last, self.worth)

    def values(self, new: list[str]) -> np.ndarray:
        """Decision values of units."""
        return np.clip(self.landmarks.weighed([letters(u) for u in new], self.worth) + self.bias, self.low, HIGHEST)

    def _valued(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """Strings, sentences and values of each text."""
        if len(self.known) > self.REMEMBER:
            self.known.clear()
        known, bags = self.known, [units(t) for t in texts]
        new = set()
        for own, _ in bags:
            new.update(own)
        fresh = [u for u in new if u not in known]
        for i in range(0, len(fresh), 50_000):
            known.update(zip(fresh[i : i + 50_000], self.values(fresh[i : i + 50_000]).tolist(), strict=True))
        return [(own, at, np.fromiter(map(known.__getitem__, own), float, len(own))) for own, at in bags]

    def witnesses(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """The witnesses of each text's three strongest sentences and their values, the highest first."""
        out = []
        for own, at, v in self._valued(texts):
            best = np.full(int(at.max(initial=-1)) + 1, -np.inf)
            np.maximum.at(best, at, v)
            top = np.argsort(-best, kind="stable")[:3]
            out.append([(own[int(np.flatnonzero((at == k) & (v == best[k]))[0])], float(best[k])) for k in top])
        return out

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """[text, 5]: values of the three strongest strings (a clear no where a text has fewer), logs of the numbers of strings and of toxic ones."""
        out = np.full((len(texts), 5), self.low)
        out[:, 3:] = 0
        if self.landmarks is not None:
            for i, (own, _, v) in enumerate(self._valued(texts)):
                if own:
                    top = np.sort(np.partition(v, len(v) - 3)[-3:] if len(v) > 3 else v)[::-1]
                    out[i, : len(top)] = top
                    out[i, 3:] = np.log1p(len(own)), np.log1p(np.count_nonzero(v > LIKELY))
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.last[:-1] + self.last[-1], -30, 30)))


def _restored(landmarks, bias, last, worth) -> Model:
    m = Model(None, None, bias, last)
    m.landmarks, m.worth = landmarks, worth
    return m


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        us, ys = [], []
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own = {w for u in units(t)[0] if len(w := letters(u)) >= ORDER}
            us += own
            ys += [y] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.string()), pa.array(ys, pa.int32())], ["unit", "toxic"])


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, strongest: int = STRONG, negatives: int = NEGATIVES, rounds: int = ROUNDS) -> Model:
    """A model from labelled documents outside the held-out third."""
    marks = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = keep(marks)
    counts = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    n1, n0 = sum(c for t, c in counts.items() if t > 0), sum(c for t, c in counts.items() if t <= 0)
    if not n1 or not n0:
        return Model(None, None, 0.0, _flat(30.0 if n1 else -30.0))
    # a third of the sample may be toxic, so that a rare class has enough to learn from
    share = {1: min(1.0, sample / 3 / n1), 0: min(1.0, 2 * sample / 3 / n0)}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30))
    chosen = marks.where(F.when(F.col("toxic") > 0, draw < int(share[1] * (1 << 30))).otherwise(draw < int(share[0] * (1 << 30))))
    met = docs.select("doc_id", "text").join(F.broadcast(keep(chosen)), "doc_id")  # at most about `sample` ids
    one = met.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x"))  # an id may have any number of rows
    texts = keep(one.select("x.text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")))
    seen = texts.groupBy("toxic").count().collect()
    m1, m0 = sum(r["count"] for r in seen if r.toxic), sum(r["count"] for r in seen if not r.toxic)
    if not m1 or not m0:
        return Model(None, None, 0.0, _flat(30.0 if m1 else -30.0))
    per = keep(texts.mapInArrow(tidy(_unit_rows), "unit string, toxic int").groupBy("unit").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")))
    ratio = (F.col("p") + 0.1) / m1 / ((F.col("n") + 0.1) / m0)
    strong = per.where((F.col("p") >= 3) & (ratio >= 8)).orderBy(F.desc(F.col("p") * F.log(ratio)), "unit").limit(strongest).collect()
    weak = per.where((F.col("n") >= 1) & (ratio < 2)).orderBy(F.xxhash64("unit")).limit(negatives).collect()
    if not strong:
        rate = (m1 / share[1]) / (m1 / share[1] + m0 / share[0])
        return Model(None, None, 0.0, _flat(float(np.log(rate / (1 - rate)))))
    names, most = [r.unit for r in strong], 2 * landmarks // 3
    every = Landmarks(names)
    own = np.zeros((len(names), len(names)))
    rows, k = every.kernel(names)
    own[rows] = k
    picked: list[int] = []
    for i in range(len(names)):
        if len(picked) < most and own[i, i] > 0 and all(own[i, j] < 0.8 * np.sqrt(own[i, i] * own[j, j]) for j in picked):
            picked.append(i)
    base = Landmarks([names[i] for i in picked])
    clean = [r.unit for r in weak]
    rows, k = base.kernel(clean)
    hard = [clean[i] for i in rows[np.argsort(-k.max(1), kind="stable")][: landmarks - len(picked)]] if len(rows) else []
    mark = Landmarks([*base.names, *hard])
    # Nyström: whiten by the landmarks' own kernel matrix
    mm = np.zeros((len(mark.names), len(mark.names)))
    rows, k = mark.kernel(mark.names)
    mm[rows] = k
    value, vector = np.linalg.eigh((mm + mm.T) / 2)
    good = value > 1e-4 * value.max()
    white = vector[:, good] / np.sqrt(value[good])
    spelled = [(s, r.p / 8) for r in strong for s in spellings(r.unit)]
    base_rows = [*[(r.unit, 1.0, float(r.p)) for r in strong], *[(s, 1.0, w) for s, w in spelled], *[(r.unit, -1.0, float(r.n)) for r in weak]]

    def fitted(train: list[tuple[str, float, float]]) -> Model:
        rows, k = mark.kernel([t[0] for t in train])
        x = np.zeros((len(train), white.shape[1]))
        x[rows] = k @ white
        y = np.array([t[1] for t in train])
        w = np.minimum(np.array([t[2] for t in train]), 50.0)
        w = np.where(y > 0, w / w[y > 0].sum(), w / max(w[y < 0].sum(), 1e-9)) * 4000.0
        weights, bias = svm(x, y, w)
        return Model(mark, white @ weights, bias, _flat(0.0))

    def told(model: Model):
        """(toxic, units, vals, e) of the sample's documents: their strongest sentences' witnesses, and their evidence."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(0).to_pylist()
                found, e = model.witnesses(texts), model.evidence(texts)
                cols = [b.column(1), pa.array([[letters(u) for u, _ in x] for x in found], pa.list_(pa.string())), pa.array([[v for _, v in x] for x in found], pa.list_(pa.float64())), pa.array(e.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, ["toxic", "units", "vals", "e"])

        got = texts.mapInArrow(tidy(run), "toxic int, units array<string>, vals array<double>, e array<double>")
        return sorted(got.collect(), key=lambda r: (r.toxic, r.e, r.units))  # at most about `sample` rows of three strings

    model = fitted(base_rows)
    for _ in range(rounds):
        bags: dict[tuple[str, float], float] = {}
        for r in told(model):
            for u, v in zip(r.units, r.vals, strict=True):
                if len(u) >= ORDER and (v > 0 if r.toxic else v > -0.9):
                    key = (u, 1.0 if r.toxic else -1.0)
                    bags[key] = bags.get(key, 0.0) + 1.0
        model = fitted(base_rows + [(u, y, c) for (u, y), c in sorted(bags.items())])
    got = told(model)
    model.last = logistic(np.array([r.e for r in got]), np.array([r.toxic for r in got]))
    # the sample's classes are thinned differently; the bias is put back to the true rate
    model.last[-1] -= float(np.log(share[1] / share[0]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.probability(model.evidence(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")
