"""Sessions, exchanges and insights as versions of DataFrames: new rows are checked against what they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def refuse(rows: DataFrame, what: str) -> None:
    """An error that names one of the rows, if there is any."""
    found = rows.take(1)
    if found:
        raise KeyError(f"{what}: {found[0].asDict()}")


def create(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """With new sessions; one with a known id takes the old one's place."""
    return sessions.join(new.select("session_id"), "session_id", "left_anti").unionByName(new)


def get(sessions: DataFrame, session_id) -> DataFrame:
    return sessions.where(F.col("session_id") == session_id)


def update(sessions: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed sessions in place of the old ones; an unknown id is an error."""
    refuse(changed.join(sessions.select("session_id"), "session_id", "left_anti").select("session_id"), "no such session")
    return create(sessions, changed)


def listed(sessions: DataFrame, status: str | None = None, platform: str | None = None, project: str | None = None, limit: int = 50) -> DataFrame:
    """Sessions that agree with every given value, the newest first."""
    for name, value in (("status", status), ("platform", platform), ("project", project)):
        if value is not None:
            sessions = sessions.where(F.col(name) == value)
    return sessions.orderBy(F.desc("created"), F.desc("session_id")).limit(limit)


def active_in(sessions: DataFrame, room: str) -> DataFrame:
    """The newest active session of a room, if there is one."""
    return listed(sessions.where(F.col("room") == room), "active", limit=1)


def end(sessions: DataFrame, session_id, as_of: Column, summary: str | None = None, themes: list[str] | None = None, status: str = "ended") -> DataFrame:
    """A session's end: its status and time; summary and themes only where given. An unknown id is an error."""
    if not get(sessions, session_id).take(1):
        raise KeyError(f"no such session: {session_id}")
    hit = F.col("session_id") == session_id
    new = {"status": F.lit(status), "ended": as_of, "updated": as_of}
    if summary is not None:
        new["summary"] = F.lit(summary)
    if themes:
        new["themes"] = F.array(*[F.lit(t) for t in themes])
    return sessions.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def add(rows: DataFrame, new: DataFrame, sessions: DataFrame) -> DataFrame:
    """With new exchanges or insights; one of an unknown session is an error."""
    refuse(new.join(sessions.select("session_id"), "session_id", "left_anti").select("session_id"), "no such session")
    return rows.unionByName(new)


def insights(rows: DataFrame, session_id) -> DataFrame:
    return rows.where(F.col("session_id") == session_id).orderBy("insight_id")


def pruned(active: DataFrame, elapsed: Column, half_life: float, threshold: float) -> DataFrame:
    """Nodes or facts of a working set (confidence, times) a turn later: recency decays, the weak ones go."""
    from graphloom.operators.search import activated

    return activated(active, elapsed, half_life).where(F.col("activation") >= threshold)


def summary(session_id, turn: int, active: DataFrame, threads: DataFrame, n: int = 10) -> str:
    """Text of a working set: open threads, decisions taken and the top nodes. threads: (id, kind, status, description, score)."""
    bounded = lambda df: df.orderBy(F.desc("score"), "id").limit(100).collect()
    parts = [f"Session: {session_id}", f"Turn: {turn}"]
    for title, rows in (("Active Threads", threads.where("status = 'active'")), ("Recent Decisions", threads.where("kind = 'decision' and status = 'resolved'"))):
        found = bounded(rows)
        if found:
            parts += ["", f"## {title}", *(f"- {r.description} ({r.score:.2f})" for r in found)]
    top = active.orderBy(F.desc("activation"), "node").limit(n).collect()
    if top:
        parts += ["", "## Top Nodes", *(f"- {r.node} ({r.activation:.3f})" for r in top)]
    return "\n".join(parts)
