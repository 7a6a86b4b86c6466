"""Training-data operators. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import mixing, substring, topk, warc
from .bpe import op6_bpe
from .mixing import op9_mixing
from .pii import op5_pii
from .quality_classifier import op10_quality_classifier
from .quality_rules import op7_quality_rules
from .simhash import op2_simhash
from .substring import op3_substring_dedup
from .toxicity import op1_toxicity
from .topk import op8_topk
from .warc import op4_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_warc": op4_warc,
    "op5_pii": op5_pii,
    "op6_bpe": op6_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_topk": op8_topk,
    "op9_mixing": op9_mixing,
    "op10_quality_classifier": op10_quality_classifier,
}
ORACLES: dict[str, str] = {
    "op3_substring_dedup": substring.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op8_topk": topk.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
