"""Toxicity, personal data, encoding and the quality operators on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, pii, quality_classifier, quality_rules, textstats, toxicity, weak
from graphloom.llm.common import table
from tests.llm.conftest import DOC, sentence

LABELS = "doc_id long, quality int, toxic int"
INSULTS = ["idiot", "moron", "worthless", "scumbag"]


def labelled(rng, n):
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = sentence(rng, 40).split()
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        docs.append((1000 + i, " ".join(w)))
        labels.append((1000 + i, 1, int(bad)))
    return docs, labels


def test_toxicity_learns_and_tolerates_gaps(spark, put, hard_docs):
    rng = random.Random(1)
    docs, labels = labelled(rng, 400)
    spelled = [(5000, "you are such an i d i o t and a w-o-r-t-h-l-e-s-s m.o.r.o.n"), (5001, "idxiot and morron and worthlesss scuumbag"), (5002, sentence(rng, 30))]
    labels += [(1001, None, None), (None, 1, 1)]
    d = put(documents=(docs + hard_docs + spelled, DOC), labels=(labels, LABELS))
    got = toxicity.op1_toxicity(spark, d).collect()
    assert len(got) == len(docs) + len(hard_docs) + len(spelled)
    by = {r.doc_id: r for r in got}
    held = [(i, t) for i, _, t in labels if i is not None and t is not None and by[i].held_out]
    assert held and all(by[i].predicted == t for i, t in held)
    assert by[5000].predicted == 1 and by[5001].score > 0.5 > by[5002].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)


def test_strings_of_sentences():
    own, at = toxicity.units("Go die now, you fool i d i o t indeed! Nothing here. " + "abcde " * 30)
    assert own[-1] == "i d i o t" and "you" in own and {"godie", "idiot"} <= set(own)  # short neighbours as one string, inside their sentence
    ends = dict(zip(own, at.tolist()))
    assert ends["nothing"] == ends["here."] and len(set(at.tolist())) == 2 + 2 + 1  # thirty words are two sentences, a spelled run is one of its own
    assert toxicity.units(None)[0] == [] and len(toxicity.units("x" * 100_000)[0]) == 1


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no fixture tables")
def test_toxicity_on_held_out_labels(spark):
    """Documents of the held-out third: some are labelled toxic without a word to show for it, so recall can't be whole."""
    found = toxicity.op1_toxicity(spark, SF).where("held_out").join(table(spark, SF, "labels").where("toxic is not null"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    right = n.get((1, 1), 0)
    assert right >= 0.9 * (right + n.get((1, 0), 0)) and right >= 0.95 * (right + n.get((0, 1), 0))


def test_toxicity_without_labels(spark, put, hard_docs):
    d = put(documents=(hard_docs, DOC), labels=([], LABELS))
    got = toxicity.op1_toxicity(spark, d).collect()
    assert len(got) == len(hard_docs) and all(r.predicted == 0 for r in got)
    d = put(documents=([], DOC))
    assert toxicity.op1_toxicity(spark, d).count() == 0


def test_kernel_is_brute_force():
    import itertools

    def slow(a, b):
        def phi(s):
            out = {}
            for i in itertools.combinations(range(len(s)), 4):
                if i[3] - i[0] < toxicity.SPAN:
                    k = "".join(s[j] for j in i)
                    out[k] = out.get(k, 0) + toxicity.DECAY ** (i[3] - i[0] - 3)
            return out

        x, y = phi(a), phi(b)
        return sum(v * y.get(k, 0) for k, v in x.items())

    names = ["idiot", "worthless", "clown"]
    mark = toxicity.Landmarks(names)
    words = ["idiot", "idxiot", "worthles", "nothing", "clownish", "abc"]
    rows, k = mark.kernel(words)
    full = np.zeros((len(words), 3))
    full[rows] = k
    for i, w in enumerate(words):
        for j, n in enumerate(names):
            assert full[i, j] == pytest.approx(slow(w, n) / toxicity._scale(len(w)) / toxicity._scale(len(n)), abs=1e-5)


def slow_base(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub("[^0-9]", "", m[0])
        if 16 <= len(g) <= 19 and sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(g))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


PERSONAL = [
    (600, "mail jo.42@mail8.example.com now"), (601, "+1 (269) 555-3296 4524132264652876 here"), (602, "host 10.0.0.1, 300.1.1.1"), (603, "😀 é a@b.c_x@d.e"),
    (604, "4041 8949 7460 8795 and 4041894974608796"), (605, "write to jo (at) mail (dot) com"), (606, "look at home.Then we"),
]


def test_pii_base_is_brute_force_and_stays(spark, put, hard_docs):
    rng = random.Random(7)
    noise = [(700 + i, "".join(rng.choice("a@.-+ ()0123456789é%_1234+@..41111111") for _ in range(rng.randint(0, 90)))) for i in range(400)]
    rows = hard_docs + PERSONAL + noise + [(9990, "1" * 30_000), (9991, "1 " * 20_000), (9992, "a@b" + ".c" * 20_000)]
    got = pii.op5_pii(spark, put(documents=(rows, DOC))).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), hashlib.sha256(",".join("%s:%d:%d" % x for x in slow_base(r[1])).encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id is not None and r.doc_id not in (8,):
            assert {"%s:%d:%d" % x for x in slow_base(texts[r.doc_id])} <= set(r.spans.split(","))


def test_pii_finds_what_the_base_drops(spark, put):
    d = put(documents=(PERSONAL, DOC))
    by = {r.doc_id: r for r in pii.op5_pii(spark, d).collect()}
    assert by[601].spans == "card:18:34,phone:0:17" and by[601].n_card == by[601].n_phone == 0
    assert by[605].spans.startswith("email:") and by[606].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(table(spark, d, "documents")).collect()}
    assert clean[601] == "<phone> <card> here" and clean[606] == "look at home.Then we"
    back = pii.redact(table(spark, d, "documents"))
    assert back.columns == table(spark, d, "documents").columns
    assert pii.redact(table(spark, put(documents=([], DOC)), "documents")).count() == 0


def test_pii_time_is_linear_in_matches(spark):
    import time

    def took(n):
        text = " ".join(f"10.{i % 200}.{i // 200 % 200}.7 or a{i}@b.example.com" for i in range(n // 2))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        row = pii.spans(docs).select(F.size("base").alias("n"), F.size("spans").alias("m")).first()
        assert (row.n, row.m) == (n, n)
        assert pii.redact(docs).first().text == " ".join(["<ip> or <email>"] * (n // 2))
        return time.perf_counter() - began

    took(400)
    assert took(16_000) < 2.6 * took(8_000) + 2


def test_pii_thresholds_hold_on_documents_left_out(spark):
    """Trees fitted without a fold of the documents, on the corpus' candidates and the seeds: precision and recall there."""
    rng = random.Random(12)
    texts = [f"{sentence(rng, 20)} mail u{i}@h{i}.example.org or from 10.{i % 250}.3.{i % 99} {rng.choice(['tel', 'order', 'and'])} +1 ({200 + i}) 555-{1000 + i} {sentence(rng, 5)}" for i in range(200)]
    rows = pii.labelled(pii.located(spark.createDataFrame([(t,) for t in texts], "txt string")))
    scored = pii.held_out(rows)
    at = pii.calibrate(scored)
    assert {y for _, y, _, _ in rows} == {0, 1} and len({f for *_, f in rows}) == pii.FOLDS
    taken = [(y, w) for k, v, y, w in scored if v >= at[k]]
    right = sum(w for y, w in taken if y)
    assert right >= 0.95 * sum(w for _, w in taken)
    assert right >= 0.9 * sum(w for _, _, y, w in scored if y)


def test_bpe_is_the_library(spark, put, hard_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    rng = random.Random(3)
    signs = "aA bB\t\nİΣσςß�é́ﬁ漢字१😀‘’'\"<|endoftext|>stdmrev l1²Ⅷ_-.,#!‍　\x1c\x85ſK"
    rows = hard_docs + [(2000 + i, "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))) for i in range(300)] + [(3000, "a<|endoftext|>b <|startoftext|>'S 'll I'M")]
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    d = put(documents=(rows, DOC))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op6_bpe(spark, d).collect()]
    assert sorted(got) == sorted(want)
    full = bpe.encode(table(spark, d, "documents")).collect()
    assert sorted((str(r.doc_id), len(r.ids)) for r in full) == sorted((w[0], w[1]) for w in want)
    assert bpe.op6_bpe(spark, put(documents=([], DOC))).count() == 0


def slow_stats(t):
    t = t or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    dup, seen = 0, set()
    for line in t.split("\n"):
        if [w for w in re.split("[\x20\x09-\x0d]+", line) if w]:
            dup += line in seen
            seen.add(line)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    from collections import Counter

    c = Counter(tri)
    cover = {j for i, x in enumerate(tri) if c[x] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in t), dup, len(cover)


def test_counts_are_brute_force(hard_docs):
    rng = random.Random(11)
    texts = [r[1] for r in hard_docs] + ["".join(rng.choice("ab #|\n\t.é") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    for t in texts:
        assert textstats.stats(t)[:5] == slow_stats(t)


def junk(rng, kind):
    w = sentence(rng, 90).split()
    return {0: " ".join(x + rng.choice(["$$$", "%%%", "&&&"]) for x in w), 1: " ".join(x.upper() + "!!" for x in w), 2: " | ".join(w), 3: " ".join(w[0] for _ in w)}[kind]


def corpus(rng, n):
    return [(4000 + i, junk(rng, i % 4) if i % 8 == 0 else " ".join(sentence(rng, 15).capitalize() for _ in range(6))) for i in range(n)]


def test_quality_rules(spark, put, hard_docs):
    rng = random.Random(2)
    rows = corpus(rng, 400)
    d = put(documents=(rows + hard_docs, DOC))
    got = quality_rules.op7_quality_rules(spark, d).collect()
    assert len(got) == len(rows) + len(hard_docs)
    texts = dict((r[0], r[1]) for r in rows)
    for r in got:
        if r.doc_id in texts:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_stats(texts[r.doc_id])
            assert r.kept == ((r.doc_id - 4000) % 8 != 0)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.op7_quality_rules(spark, put(documents=([], DOC))).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.8
    acc = [0.95, 0.9, 0.8, 0.6]
    v = np.stack([np.where(rng.random(4000) < 0.3, -1, np.where(rng.random(4000) < a, y, ~y).astype(int)) for a in acc], 1)
    p, c = np.unique(v, axis=0, return_counts=True)
    m = weak.fit(p, c)
    q = m.posterior(v)
    assert ((q > 0.5) == y).mean() > 0.93
    est = m.accuracy()[:, 1]
    assert est[0] > est[3] and est[1] > est[3]


def test_quality_classifier_keeps_clean_and_drops_junk(spark, put, hard_docs):
    rng = random.Random(3)
    rows = corpus(rng, 400)
    d = put(documents=(rows + hard_docs, DOC))
    got = {r.doc_id: r for r in quality_classifier.op10_quality_classifier(spark, d).collect()}
    wrong = [r[0] for r in rows if got[r[0]].kept != ((r[0] - 4000) % 8 != 0)]
    assert len(wrong) <= 4
    assert not got[1].kept and not got[2].kept and not got[3].kept
    docs = table(spark, d, "documents")
    kept = quality_classifier.filter_documents(docs, quality_classifier.fit(docs))
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in quality_classifier.op10_quality_classifier(spark, d).collect())
    assert quality_classifier.op10_quality_classifier(spark, put(documents=([], DOC))).count() == 0


def test_quality_scores_do_not_depend_on_what_was_read_before(spark):
    import itertools

    # over 6000 shapes of twelve signs in two encoded documents, read before or after the plain ones
    shapes = ["".join(x) for x in itertools.product("aA0", repeat=12) if all(a != b for a, b in itertools.pairwise(x))]
    assert len(set(map(quality_classifier.shape, shapes))) == len(shapes) > 5000
    late = ["x-1 Y_2 (z) q=3; #4 w/5", "A1b2 c3D4 <e> {f} [g]", "http://h.i/j?k=1 l@m.n $5 %6"]
    rows = [(0, " ".join(shapes[::2])), (1, " ".join(shapes[1::2])), *((i + 2, x) for i, x in enumerate(late))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    w = np.random.default_rng(1).normal(size=1 << quality_classifier.BITS) * 9
    got = [{r.doc_id: r.score for r in quality_classifier.score(d, w).collect()} for d in (docs, docs.orderBy(F.desc("doc_id")).coalesce(1), docs.repartition(5, "doc_id"))]
    assert got[0] == got[1] == got[2]
    fresh = {i: quality_classifier.Features()(x) for i, x in rows}
    small = quality_classifier.Features(remember=10)
    assert all((a == c).all() and (b == d).all() for i, x in rows for (a, b), (c, d) in [(fresh[i], small(x))])


def test_quality_of_long_words_and_repeated_ids(spark):
    assert quality_classifier.shape("aB" * 50) == "aA" * 50  # whole words, no prefix
    rng = random.Random(8)
    rows = [(1, t) for _, t in corpus(rng, 120)] + [(2, "same text " * 40)] * 300 + [(None, None), (3, "")]
    fits = [quality_classifier.fit(spark.createDataFrame(r, "doc_id long, text string").repartition(n)) for r, n in ((rows, 3), (rows[::-1], 5))]
    assert np.array_equal(fits[0], fits[1])  # neither order nor partitions nor repeated ids change the fit


@pytest.mark.parametrize("seed", range(3))
def test_quality_scorer_is_fitted_to_the_end(seed):
    rng = np.random.default_rng(seed)
    x = ((rng.random((600, 64)) < 1 / np.arange(1, 65)) * rng.random((600, 64))).astype(np.float32)  # rare slots at the end
    x[:, 0] = 1
    y = 1 / (1 + np.exp(-(x @ (2 * rng.normal(size=64)))))
    w = quality_classifier.fit_scorer(x, y, np.ones(600))
    assert np.linalg.norm((1 / (1 + np.exp(-(x @ w))) - y) @ x / 600 + 1e-4 * w) < 1e-7


def test_redaction_covers_the_end_of_overlapping_spans(spark):
    def luhn(n):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(n))) % 10 == 0

    card = next(str(n) for n in range(4111111111111110, 4111111111111300) if luhn(f"{n}10"))
    rows = [(1, f"pay {card} 10.0.0.1 now"), (2, "host 10.0.0.1 now"), (3, "plain text"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: sorted((s.start, s.end) for s in r.spans) for r in pii.spans(docs).collect()}
    (a, b), (c, d) = found[1]
    assert a < c < b < d  # the case is there: the second span starts inside the first and ends beyond it
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got[1].endswith("> now") and got[1].count("<") == 1 and ".0.0.1" not in got[1]
    assert got[2] == "host <ip> now" and got[3] == "plain text" and got[4] is None
