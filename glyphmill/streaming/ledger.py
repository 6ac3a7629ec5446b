"""Streaming forms of the ledger, dashboards, run lifecycle, rate limiting and incremental dedup.

Each takes and returns a streaming DataFrame (batch ones work too, where nothing is stateful). Windows are bounded by
watermarks; the state of runs and keys has a row for each of them. The caller picks sink, trigger and checkpoint location.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_cost(usage: DataFrame, late: str = "2 days") -> DataFrame:
    """Cost by day and provider, final once the watermark passes the day. created_at is a timestamp with session zone."""
    w = usage.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day"), "provider")
    return w.agg(F.sum("cost_usd").alias("total_cost"), F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "provider", "total_cost", "n")


def recent_velocity(validations: DataFrame, window: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Judgments and distinct images (approximately) per rater in sliding windows."""
    w = validations.withWatermark("created_at", late).groupBy(F.window("created_at", window, slide), "user_id")
    return w.agg(F.count("*").alias("n"), F.approx_count_distinct("image_id").alias("images"), F.avg("duration_ms").alias("avg_ms"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_seen(rows: DataFrame, key: str, ts: str = "created_at", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def job_status(items: DataFrame) -> DataFrame:
    """Per job, from the last status of its items: counts, and COMPLETED, COMPLETED_WITH_ERRORS, FAILED or RUNNING."""
    done, bad, n = F.count_if(F.col("status") == "COMPLETED"), F.count_if(F.col("status") == "FAILED"), F.count("*")
    c = items.groupBy("job_id").agg(n.alias("total"), done.alias("completed"), bad.alias("failed"))
    whole = F.col("completed") + F.col("failed") == F.col("total")
    return c.withColumn("status", F.when(whole & (F.col("failed") == 0), "COMPLETED").when(whole & (F.col("completed") == 0), "FAILED").when(whole, "COMPLETED_WITH_ERRORS").otherwise("RUNNING"))


#: What an event does to a run; anything else leaves it as it is.
TRANSITIONS = {("PENDING", "start"): "RUNNING", ("RUNNING", "complete"): "COMPLETED", ("RUNNING", "fail"): "FAILED", ("PENDING", "fail"): "FAILED", ("FAILED", "retry"): "PENDING", ("STALE", "retry"): "PENDING", ("COMPLETED", "expire"): "STALE"}


def run_lifecycle(events: DataFrame) -> DataFrame:
    """events: run_id, event, at. The status of each run after each batch of its events, in order of time.

    The state has a row for every run that has had an event.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else ("PENDING", 0)
        rows = pd.concat(batches).sort_values("at", kind="stable")
        for e in rows.event:
            new = TRANSITIONS.get((status, e))
            n += new is None
            status = new or status
        state.update((status, n))
        yield pd.DataFrame({"run_id": [key[0]], "status": [status], "refused": [n]})

    return events.groupBy("run_id").applyInPandasWithState(step, "run_id long, status string, refused long", "status string, refused long", "update", GroupStateTimeout.NoTimeout)


def allow(hits: list[float], seen: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float], list[float]]:
    """Decide hits in order of time: allowed while fewer than `limit` allowed ones are within `seconds`; a refused one isn't recorded."""
    out, wait = [], []
    for t in hits:
        seen = [s for s in seen if s > t - seconds]
        ok = len(seen) < limit
        out.append(ok)
        wait.append(0.0 if ok else max(0.0, seen[0] + seconds - t))
        if ok:
            seen.append(t)
    return out, wait, seen


#: Requests a minute by role.
ROLE_LIMITS = {"admin": 1000, "reviewer": 500, "proposer": 200, "viewer": 100, "anonymous": 30}


def role_limits(requests: DataFrame) -> DataFrame:
    """requests: key, id, at, role. The limit that holds for each, by role; other roles are anonymous. For rate_limit(..., "limit", 60)."""
    limits = F.create_map(*(F.lit(x) for kv in ROLE_LIMITS.items() for x in kv))
    return requests.withColumn("limit", F.coalesce(F.try_element_at(limits, F.lower("role")), F.lit(ROLE_LIMITS["anonymous"])))


def rate_limit(requests: DataFrame, limit: int | str, seconds: float) -> DataFrame:
    """requests: key, id, at (seconds). Sliding-window limiter: whether each is allowed, and for how long to wait.

    limit: a number, or the column that holds it (of a key's first request in a batch). The
    state has a row for every key, of at most `limit` times.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["at", "id"], kind="stable")
        ok, wait, seen = allow(rows["at"].tolist(), list(state.get[0]) if state.exists else [], limit if isinstance(limit, int) else int(rows[limit].iloc[0]), seconds)
        state.update((seen,))
        yield pd.DataFrame({"key": key[0], "id": rows["id"].to_numpy(), "allowed": ok, "retry_after": wait})

    return requests.groupBy("key").applyInPandasWithState(step, "key string, id long, allowed boolean, retry_after double", "seen array<double>", "append", GroupStateTimeout.NoTimeout)
