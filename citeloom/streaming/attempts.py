"""The classifier's attempt state machine over a log of stored replies, as a batch fold and as a stateful stream.

A log row is a reply (context, seq, by_router, kind), kind ``valid``, ``invalid`` or ``error``. Rules decide a context of the router at its first
reply. A model is asked up to ``TRIES`` times until it replies; a valid reply ends the attempt, an invalid one is repaired
once, and an error while repairing ends it. What comes after the end is ignored. A context whose log stops earlier is pending.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIES = 3
PENDING = "pending"


def _step(state: Column, reply: Column) -> Column:
    """The state (status, errors, repairing) after a reply."""
    status, errors, repairing = state["status"], state["errors"], state["repairing"]
    kind, router = reply["kind"], reply["by_router"]
    failed = kind == "error"
    end = (
        F.when(status != PENDING, status)
        .when(router, F.when(kind == "valid", "router_valid").otherwise("rejected_router_validation"))
        .when(repairing, F.when(failed, "api_error").when(kind == "valid", "repaired_valid").otherwise("rejected_after_repair"))
        .when(failed, F.when(errors + 1 >= TRIES, "api_error").otherwise(PENDING))
        .otherwise(F.when(kind == "valid", "initial_valid").otherwise(PENDING))
    )
    asks = (status == PENDING) & ~router & ~repairing
    return F.struct(end.alias("status"), (errors + (asks & failed).cast("int")).alias("errors"), (repairing | (asks & (kind == "invalid"))).alias("repairing"))


def final_statuses(log: DataFrame) -> DataFrame:
    """(context, status, replies) of every context, its replies taken in the order of ``seq``."""
    replies = log.groupBy("context").agg(F.sort_array(F.collect_list(F.struct("seq", "by_router", "kind"))).alias("r"))
    start = F.struct(F.lit(PENDING).alias("status"), F.lit(0).alias("errors"), F.lit(False).alias("repairing"))
    return replies.select("context", F.aggregate("r", start, _step)["status"].alias("status"), F.size("r").cast("long").alias("replies"))


def after_reply(status: str, errors: int, repairing: bool, kind: str, router: bool) -> tuple[str, int, bool]:
    """``_step`` on plain values, for the stream's state."""
    if status != PENDING:
        return status, errors, repairing
    if router:
        return ("router_valid" if kind == "valid" else "rejected_router_validation"), errors, repairing
    if repairing:
        return {"error": "api_error", "valid": "repaired_valid"}.get(kind, "rejected_after_repair"), errors, repairing
    if kind == "error":
        return ("api_error" if errors + 1 >= TRIES else PENDING), errors + 1, False
    return ("initial_valid", errors, False) if kind == "valid" else (PENDING, errors, True)


def stream_statuses(log: DataFrame) -> DataFrame:
    """Of a stream of replies each context's status after every trigger that brings replies of it; replies must come in order."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, errors, repairing, n = state.get if state.exists else (PENDING, 0, False, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for kind, router in zip(rows["kind"], rows["by_router"], strict=True):
            status, errors, repairing = after_reply(status, errors, repairing, kind, bool(router))
        n += len(rows)
        state.update((status, errors, repairing, n))
        yield pd.DataFrame({"context": [key[0]], "status": [status], "replies": [n]})

    return log.groupBy("context").applyInPandasWithState(
        advance, "context long, status string, replies long", "status string, errors int, repairing boolean, n long", "update", "NoTimeout"
    )
