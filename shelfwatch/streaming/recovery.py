"""Streaming twin of the recovery fold: the same step, kept as state for each incident."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.lifecycle import recovery_step


def recovery_stream(observations: DataFrame, key: str = "incident_id", at: str = "at", initial: str = "open") -> DataFrame:
    """(key, at, status, event) of a stream of observations (key, at, snapshot, comparable, healthy), incident by incident.

    Observations of an incident are taken in order within a batch; a later batch goes on from its state.
    """
    kinds = f"{key} {observations.schema[key].dataType.simpleString()}, {at} {observations.schema[at].dataType.simpleString()}, status string, event string"

    def step(keys, batches, state):
        status, last = state.get if state.exists else (initial, None)
        rows = pd.concat(list(batches)).sort_values([at, "snapshot"], kind="stable")
        out = []
        for t, snapshot, comparable, healthy in rows[[at, "snapshot", "comparable", "healthy"]].itertuples(index=False):
            event = ""
            if str(snapshot) != last:
                status, event = recovery_step(status, bool(comparable), bool(healthy))
            last = str(snapshot)
            out.append((keys[0], t, status, event))
        state.update((status, last))
        yield pd.DataFrame(out, columns=[key, at, "status", "event"])

    return observations.groupBy(key).applyInPandasWithState(step, kinds, "status string, last string", "append", GroupStateTimeout.NoTimeout)
