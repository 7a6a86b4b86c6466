import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, score double, kept boolean, row int, h long"
WORDS = "the and of then river stone lamp quiet garden winter morning letter table window bread salt horse field copper wheel".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n)) + "."


@pytest.fixture
def put(spark, tmp_path):
    """Writes tables of a fixture folder: put(documents=(rows, schema), ...) gives its path. Document rows may be (id, text) or (id, text, source)."""

    def run(**tables):
        for name, (rows, schema) in tables.items():
            if name == "documents":
                rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", 0, "x", 7, 0.5, True, 3, 9) for r in rows]
            spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return run


@pytest.fixture
def hard_docs():
    """Nulls, empties, blanks, ties, repeats, a long text, a null id."""
    rng = random.Random(5)
    long_text = sentence(rng, 30_000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, sentence(rng, 80)), (6, long_text), (None, sentence(rng, 60)), (7, "é" * 50 + " ünï " * 40)]
    rows += [(8, rows[4][1]), (8, rows[4][1]), (9, rows[4][1] + " more"), (10, "it " * 300), (11, "a\x00b \x1f c"), (12, None, None), (13, sentence(rng, 70), None)]
    return rows
