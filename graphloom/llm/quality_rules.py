"""Quality rules as weak supervision: rules vote or abstain, and a posterior replaces all-must-pass.

Each rule turns the exact counts of a whole text into a vote: 0 (bad), 1 (good) or -1 (abstains, when the
text gives it too little to go by). Expectation-maximisation over the pattern counts of all documents gives
each rule's accuracies; the posterior probability of good quality decides. Two rules stay hard by
contract: fewer than 50 words, or more than half of the words in repeated 3-word windows.

Defined cases: a null or wordless text has zero counts, fails the base rules and is not kept; repeated rows
get equal verdicts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import weak
from .common import keep, table, tidy
from .textstats import NAMES, stats

KEEP_AT = 0.5


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """[document, rule] of 1, 0 or -1 from the counts. Most rules know one kind of junk and else abstain; the last two know prose."""
    n = np.maximum(s["n_words"], 1).astype(float)
    letters = np.maximum(s["n_letters"], 1).astype(float)
    lines = np.maximum(s["n_lines"], 1).astype(float)
    enough = s["n_words"] >= 20
    bad = lambda x, when=enough: np.where(when & x, 0, -1)
    good = lambda x, when=enough: np.where(when & x, 1, -1)
    ends, symbols = s["n_ends"] / n, s["n_symbols"] / n
    calm = (symbols <= 0.03) & (s["n_bangs"] <= 0.02 * n) & (s["n_same"] <= 0.04 * n)
    return np.stack(
        [
            bad(symbols >= 0.25),  # junk symbols
            bad(s["n_marked"] >= 0.15 * n),  # words that end in doubled symbols
            bad(s["n_upper"] >= 0.40 * letters),  # capitals
            bad(s["n_bangs"] >= 0.15 * n),  # shouting
            bad(s["n_bars"] >= 0.15 * n),  # menus and tables
            bad(s["n_repeat_words"] >= 0.35 * n),  # boilerplate and loops
            bad(s["n_same"] >= 0.20 * n),  # a word again and again
            bad(s["n_dup_lines"] >= 0.30 * lines, enough & (s["n_lines"] >= 4)),  # lines again and again
            bad(s["n_distinct"] <= 1.5 * np.sqrt(n)),  # hardly any vocabulary
            bad(s["word_chars"] >= 15 * n),  # encoded data
            bad(ends <= 0.002, s["n_words"] >= 200),  # no sentences
            good((ends >= 0.02) & (ends <= 0.34) & calm & (s["n_upper"] <= 0.15 * letters) & (s["n_repeat_words"] <= 0.10 * n)),
            good((s["n_distinct"] >= 4.0 * np.sqrt(n)) & calm & (s["n_bars"] <= 0.02 * n) & (s["n_upper"] <= 0.20 * letters)),
        ],
        axis=1,
    ).astype(np.int8)


RULES = 13
_SCHEMA = "doc_id long, " + ", ".join(f"{x} long" for x in NAMES) + ", votes string"


def counted(texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
    """([text, count of NAMES], votes of each text as a string of 0, 1 and -, a character a rule)."""
    m = np.array([stats(t) for t in texts], np.int64).reshape(-1, len(NAMES))
    v = votes({k: m[:, i] for i, k in enumerate(NAMES)})
    return m, ["".join(r) for r in np.array(["-", "0", "1"])[v + 1]]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts of NAMES, votes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, text = counted(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[:, i]) for i in range(len(NAMES))), pa.array(text, pa.string())], ["doc_id", *NAMES, "votes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), _SCHEMA)


def pattern_posteriors(measures: DataFrame) -> list:
    """(row of votes and count, p_good) of every pattern that occurs; at most 3^rules, whatever the input."""
    seen = measures.groupBy("votes").count().orderBy("votes").collect()
    p = np.array([[{"0": 0, "1": 1, "-": -1}[c] for c in r.votes] for r in seen]).reshape(-1, RULES)
    model = weak.fit(p, np.array([r["count"] for r in seen], float))
    q = model.posterior(p) if len(p) else []
    return [(r, float(x)) for r, x in zip(seen, q, strict=True)]


def posteriors(measures: DataFrame) -> DataFrame:
    """(votes, p_good) of every pattern that occurs."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kind = StructType([StructField("votes", StringType()), StructField("p_good", DoubleType())])
    return measures.sparkSession.createDataFrame([(r.votes, p) for r, p in pattern_posteriors(measures)], kind)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    m = keep(measured(docs, id_col, text_col))
    by = F.broadcast(posteriors(m))  # bounded by the number of vote patterns
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.join(by, "votes").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= KEEP_AT))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    r = judge(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))
