"""A join-detection run over the stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from lakewarden.operators.joins import detect_candidates, mine_query_log, strongest_first
from lakewarden.operators.state import add_candidates, outstanding_proposals, prune_candidates


def detect_run(
    state: DataFrame, columns_meta: DataFrame, audit: DataFrame, metrics: DataFrame, now: Column, *,
    queue_cap: int | None = None, latest: int | None = None,
) -> DataFrame:
    """Next snapshot plus `change`: prune, add heuristic candidates, then mined
    joins. All of them are kept, unless the caller gives the length of a review
    queue: then the strongest fill what is left of it."""
    pruned = prune_candidates(state, columns_meta)
    guesses = detect_candidates(columns_meta)
    mined = mine_query_log(audit, columns_meta, latest=latest)
    if queue_cap is not None:
        # Guesses are no drafts, so they do not wait in the queue.
        waiting = outstanding_proposals(pruned, metrics).first()["outstanding"]
        mined = mined.orderBy(*strongest_first()).limit(max(0, queue_cap - waiting))
    return add_candidates(pruned, [guesses, mined], now)
