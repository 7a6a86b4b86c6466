"""Degrading service: levels, fallbacks and the retrieval that goes with each level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("full", "cold", "minimal", "offline")


class Health:
    """The service level from what fails; three successes in a row clear a part's failure."""

    def __init__(self, clear_after: int = 3):
        self.clear_after = clear_after
        self.bad: dict[str, int] = {}

    def failed(self, part: str) -> None:
        if part not in ("storage", "embeddings", "graph"):
            raise ValueError(part)
        self.bad[part] = 0

    def succeeded(self, part: str) -> None:
        if part in self.bad:
            self.bad[part] += 1
            if self.bad[part] >= self.clear_after:
                del self.bad[part]

    @property
    def level(self) -> str:
        if "storage" in self.bad:
            return "offline"
        if "embeddings" in self.bad and "graph" in self.bad:
            return "minimal"
        return "cold" if "embeddings" in self.bad else "minimal" if "graph" in self.bad else "full"


def with_fallback(primary: Callable[[], DataFrame], fallback: Callable[[], DataFrame]) -> tuple[DataFrame, str | None]:
    """(result, warning): the fallback's plan if the primary's can't be built."""
    try:
        return primary(), None
    except Exception as e:  # whatever the primary raises is what the fallback is for
        return fallback(), f"degraded: {e}"


def cold_facts(facts: DataFrame, limit: int) -> DataFrame:
    """Facts by weight alone."""
    return facts.orderBy(F.desc("weight"), "id").limit(limit)


def retrieve(health: Health, full: Callable[[], DataFrame], facts: DataFrame, limit: int) -> tuple[DataFrame, str]:
    """(facts, level used): full retrieval, else the heaviest facts, else any, else none."""
    level = health.level
    if level == "full":
        try:
            return full(), "full"
        except Exception:  # a failing part is a lower level, not an error
            health.failed("embeddings")
            level = "cold"
    if level == "cold":
        return cold_facts(facts, limit), "cold"
    return (facts.orderBy("id").limit(limit), "minimal") if level == "minimal" else (facts.limit(0), "offline")
