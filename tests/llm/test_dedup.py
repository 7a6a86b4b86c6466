"""SimHash groups and substring removal against brute force."""

import hashlib
import random

import numpy as np
from xxhash import xxh64_intdigest

from graphloom.llm import simhash, substring
from tests.llm.conftest import DOC, sentence


def slow_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    if not words:
        return 0
    sh = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hs = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows, threshold=4):
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), f"{f:016x}", str(least.get(find(i)))) for i, (r, f) in enumerate(zip(rows, fps)))


def near_copies(rng, n):
    rows, base = [], [sentence(rng, 150) for _ in range(12)]
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(w)
        rows.append((100 + i, " ".join(w)))
    return rows


def test_simhash_is_brute_force(spark, put, hard_docs):
    rows = hard_docs + near_copies(random.Random(1), 150)
    got = simhash.op2_simhash(spark, put(documents=(rows, DOC)))
    assert sorted(tuple(map(str, r)) for r in got.collect()) == slow_components(rows)


def test_links_lose_nothing_in_hot_anchors(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(150):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    from graphloom.llm.common import components

    got = {r.node: r.root for r in components(simhash.links(df, chunk=16)).collect()}
    u = np.array(fps, np.int64).view(np.uint64)
    label = np.arange(len(u))
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    while True:
        new = np.array([label[near[i]].min() for i in range(len(u))])
        if (new == label).all():
            break
        label = new
    for i, x in enumerate(fps):
        assert got.get(x, x) == min(fps[j] for j in range(len(u)) if label[j] == label[i])


def test_anchor_cover_is_complete(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        pairs.append(tuple(v - (1 << 64) if v >= 1 << 63 else v for v in (x, y)))
    df = spark.createDataFrame(pairs, "a long, b long").select(simhash.anchors("a").alias("a"), simhash.anchors("b").alias("b"))
    for r in df.collect():
        assert set(r.a) & set(r.b)
        assert len(r.a) <= 34


def slow_removal(rows, n=50):
    words = {i: (t or "").encode().split() for i, (_, t, *_) in enumerate(rows)}
    out = []
    first = {}
    for i, (d, *_) in enumerate(rows):
        if d is None:
            continue
        for k in range(len(words[i]) - n + 1):
            key = b" ".join(words[i][k : k + n])
            first[key] = min(first.get(key, d), d)
    for i, (d, *_) in enumerate(rows):
        gone = set()
        if d is not None:
            for k in range(len(words[i]) - n + 1):
                if first[b" ".join(words[i][k : k + n])] < d:
                    gone.update(range(k, k + n))
        kept = b" ".join(w for k, w in enumerate(words[i]) if k not in gone)
        out.append((str(d), len(words[i]), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring_removal_is_brute_force(spark, put, hard_docs):
    rng = random.Random(9)
    passage = [sentence(rng, 75) for _ in range(3)]
    rows = list(hard_docs) + near_copies(rng, 60)
    for i in range(30):
        rows.append((300 + i, " ".join([sentence(rng, rng.randint(0, 40)), rng.choice(passage), sentence(rng, 20), "it " * rng.randint(0, 120)])))
    rows.append((400, passage[0]))
    rows.append((400, "other part " + passage[1]))  # an id in two parts
    got = substring.op3_substring_dedup(spark, put(documents=(rows, DOC)))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == slow_removal(rows)


def test_more_levels_give_the_same(spark, put):
    rng = random.Random(4)
    rows = near_copies(rng, 40)
    from graphloom.llm.common import table

    docs = table(spark, put(documents=(rows, DOC)), "documents")
    a = sorted(map(tuple, substring.remove_repeats(docs, 20, 10).collect()))
    b = sorted(map(tuple, substring.remove_repeats(docs, 20, 4).collect()))
    assert a == b and sum(x[2] for x in a) > 0


def test_empty_tables(spark, put):
    d = put(documents=([], DOC))
    assert simhash.op2_simhash(spark, d).count() == 0
    assert substring.op3_substring_dedup(spark, d).count() == 0
