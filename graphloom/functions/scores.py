"""Scoring expressions: fusion signals, confidence parts, activation, blends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FusionWeights:
    similarity: float
    confidence: float
    recency: float
    distance: float
    sources: float

    def __post_init__(self):
        w = (self.similarity, self.confidence, self.recency, self.distance, self.sources)
        if min(w) < 0 or abs(sum(w) - 1) > 0.01:
            raise ValueError("fusion weights must not be negative and must add up to 1")


#: Presets of signal weights.
FUSION = {
    "default": FusionWeights(0.35, 0.25, 0.20, 0.10, 0.10),
    "verification": FusionWeights(0.15, 0.40, 0.15, 0.10, 0.20),
    "exploration": FusionWeights(0.50, 0.15, 0.10, 0.15, 0.10),
}
#: Weights of the spring, node2vec and spectral vectors.
BLENDS = {"balanced": (0.34, 0.33, 0.33), "exploratory": (0.2, 0.3, 0.5), "precise": (0.5, 0.3, 0.2), "discovery": (0.2, 0.5, 0.3)}


def unit(x: Column) -> Column:
    """[-1, 1] to [0, 1], clamped."""
    return F.least(F.greatest((x + 1) / 2, F.lit(0.0)), F.lit(1.0))


def recency(seen: Column, as_of: Column) -> Column:
    """Halves every 30 whole days; the future counts as now."""
    days = F.floor((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(seen.cast("timestamp"))) / 86400)
    return F.pow(F.lit(2.0), -F.greatest(days, F.lit(0)) / 30.0)


def nearness(d: Column) -> Column:
    return F.when(d == 0, 1.0).when(d >= 10, 0.0).otherwise(1 - d / 10.0)


def support(n: Column) -> Column:
    return F.least(n, F.lit(10)) / 10.0


def fusion(w: FusionWeights, similarity: Column, confidence: Column, rec: Column, distance: Column, sources: Column) -> Column:
    return w.similarity * unit(similarity) + w.confidence * confidence + w.recency * rec + w.distance * nearness(distance) + w.sources * support(sources)


def blend(weights: tuple[float, float, float], *scores: Column) -> Column:
    """Weighted mean over the strategies that have a score; 0 without any."""
    total = sum(F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for w, s in zip(weights, scores, strict=True))
    value = sum(F.coalesce(s, F.lit(0.0)) * w for w, s in zip(weights, scores, strict=True))
    return F.when(total > 0, value / total).otherwise(0.0)


def confidence(reliability: Column, diversity: Column, centrality: Column) -> Column:
    return 0.5 * reliability + 0.3 * diversity + 0.2 * centrality


def activation(conf: Column, rec: Column, times: Column) -> Column:
    """After the first use: confidence, e-folding recency and saturating use count."""
    return 0.5 * conf + 0.3 * rec + 0.2 * F.log1p(times) / F.log(F.lit(11.0))


#: Factor of each feedback signal, and the range of weights.
FACTORS = {"cited": 1.5, "relevant": 1.2, "ignored": 0.9, "misleading": 0.7}
DELTAS = {"cited": 0.5, "relevant": 0.5, "ignored": -0.3, "misleading": -0.3}
REWARDS = {"cited": 1.0, "relevant": 0.5, "ignored": -0.3, "misleading": -1.0}
LOW, HIGH = 0.1, 10.0


def mapped(values: dict[str, float], signal: Column, other: float | None = None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(signal == k, F.lit(v)) if out is None else out.when(signal == k, F.lit(v))
    return out.otherwise(F.lit(other).cast("double"))


def adjusted(weight: Column, signal: Column, mode: str = "multiplicative", damping: float = 0.5) -> Column:
    """A weight after one feedback signal, clamped."""
    times, plus = weight * mapped(FACTORS, signal, 1.0), mapped(DELTAS, signal, 0.0)
    raw = {"multiplicative": times, "additive": weight + plus, "hybrid": damping * times + (1 - damping) * plus}[mode]
    return F.least(F.greatest(raw, F.lit(LOW)), F.lit(HIGH))


def duration(seconds: Column) -> Column:
    """Seconds as days, hours, minutes and seconds ("1d 0h 2m 5s"), from the largest unit that counts."""
    s = seconds.cast("long")
    units = [(s >= 86400, F.floor(s / 86400), "d"), (s >= 3600, F.floor(s % 86400 / 3600), "h"), (s >= 60, F.floor(s % 3600 / 60), "m"), (F.lit(True), s % 60, "s")]
    return F.concat_ws(" ", *[F.when(c, F.concat(n.cast("long").cast("string"), F.lit(u))) for c, n, u in units])
