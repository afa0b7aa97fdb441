"""Keyed state over a stream of runs: strikes of rate limits per source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimloom.operators.fleet import SUCCESS


def strikes(runs: DataFrame, most: int = 4) -> DataFrame:
    """After each batch the strikes of the sources it touched: one more for each RATE_LIMITED run, none after a success, ``most`` at most.

    Runs of a batch count in the order of time and id; a batch's runs are taken to be newer than those of batches before it. The state of a
    source is one number, so it doesn't grow with its history.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for status in pd.concat(list(batches)).sort_values(["started_at", "run_id"])["status"]:
            n = 0 if status in SUCCESS else min(most, n + 1) if status == "RATE_LIMITED" else n
        state.update((n,))
        yield pd.DataFrame({"source_id": [key[0]], "strikes": [n]})

    return runs.select("source_id", "run_id", "started_at", "status").groupBy("source_id").applyInPandasWithState(fold, "source_id long, strikes int", "strikes int", "update", GroupStateTimeout.NoTimeout)
