"""Streaming twin of the candidates: one keyed state a store and configuration, and a timer at its deadline."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.candidates import ASKED, EXPIRY_MINUTES, FIRST, LATEST, described, verdict

HELD = "opened_at timestamp, seen_at timestamp, drops long, baseline_id string, baseline_version int, baseline_median double, first_snapshot_id string, observed double, percent_threshold double, absolute_threshold double, threshold_version int, threshold_hash string"
ENDED = f"store_id string, config string, {HELD}, ended_at timestamp, expired boolean, asked struct<snapshot_id:string,observed:double,active_baseline_id:string,active_config:string,snapshot_config:string,source_status:string>"
NAMES = [x.split()[0] for x in HELD.split(", ")]
EXPIRY = datetime.timedelta(minutes=EXPIRY_MINUTES)


def _cells(row, names: list[str]) -> list:
    """Cells of a row as Python values, null for what pandas calls missing; whole numbers beside nulls come as doubles."""
    cells = [None if pd.isna(row[c]) else row[c].item() if hasattr(row[c], "item") else row[c] for c in names]
    return [int(v) if v is not None and c.endswith("_version") else v for c, v in zip(names, cells, strict=True)]


class Pending(StatefulProcessor):
    """Holds the pending candidate of a key; gives the candidates that end, with what ended them."""

    def __init__(self, zone: str):
        self.zone = zone

    def _millis(self, at: datetime.datetime) -> int:
        """A time of the session's zone as a timer's."""
        return int(pd.Timestamp(at).tz_localize(self.zone).value // 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("pending", HELD)

    def _end(self, key, at, expired: bool, asked) -> dict:
        row = dict(zip(NAMES, self.held.get(), strict=True)) | {"store_id": key[0], "config": key[1], "ended_at": at, "expired": expired, "asked": asked}
        self._forget()
        return row

    def _forget(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.held.clear()

    def _take(self, key, row, out: list) -> None:
        """One row of the log, against the pending candidate."""
        at = row["at"].to_pydatetime()
        if self.held.exists() and self.held.get()[1] + EXPIRY <= at:  # its timer would have come before this row
            out.append(self._end(key, self.held.get()[1] + EXPIRY, True, None))
        if row["kind"] == "confirm":
            if self.held.exists():
                out.append(self._end(key, at, False, tuple(_cells(row, ASKED))))
            return
        latest = _cells(row, LATEST)
        if self.held.exists():
            old = self.held.get()
            kept = [old[0], at, old[2] + 1, *old[3:6]]
            self._forget()
        else:
            kept = [at, at, 1, *_cells(row, FIRST)]
        self.held.update((*kept, *latest))
        self.handle.registerTimer(self._millis(at + EXPIRY))

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows))
        frame["late"] = frame["kind"] == "confirm"
        out: list = []
        for _, row in frame.sort_values(["at", "late", "snapshot_id"], kind="stable").iterrows():
            self._take(key, row, out)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        if self.held.exists() and self._millis(self.held.get()[1] + EXPIRY) <= expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._end(key, self.held.get()[1] + EXPIRY, True, None))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["store_id", "config", *NAMES, "ended_at", "expired", "asked"])


def candidate_stream(log: DataFrame, delay: str = "1 minute") -> DataFrame:
    """The ended candidates of a stream of log rows (columns of operators.candidates.LOG), as operators.candidates gives them.

    A candidate that nothing confirms ends when the watermark passes its deadline, whether or not its key has rows again.
    Rows of a key must come in order of time but for those of one batch. Needs RocksDBStateStoreProvider as state store.
    """
    ended = (log.withWatermark("at", delay).groupBy("store_id", "config")
             .transformWithStateInPandas(statefulProcessor=Pending(log.sparkSession.conf.get("spark.sql.session.timeZone")), outputStructType=ENDED, outputMode="append", timeMode="EventTime"))
    reason = F.when(F.col("expired"), "confirmation_window_expired").otherwise(verdict(F.col("asked"), F.col("baseline_id"), F.col("config"), F.col("baseline_median"), F.col("percent_threshold"), F.col("absolute_threshold")))
    return described(ended.withColumns({"status_reason": reason, "confirmation_snapshot_id": F.col("asked.snapshot_id"), "confirmed_value": F.col("asked.observed")}))
