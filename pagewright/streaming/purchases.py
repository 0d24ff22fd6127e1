"""Purchases and refunds as keyed state: what each event does to its purchase, whatever order events come in.

A key's state is its purchase, the ids of events that it has seen, and refunds that wait for a purchase. State lives in the
state store by key and checkpoint, so a run that is stopped, killed or replayed goes on where it was, and no batch reads what
was written before. Timers let go of ids and of waiting refunds once they are old, so a key's state stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

#: The state store that keeps several states and timers for a key, on disk.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 86_400_000


def keep_state(spark: SparkSession) -> None:
    """Let streams that start in this session from now on keep their state in PROVIDER, unless another store is set."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name).endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(name, PROVIDER)


#: Fixed value: shares of a key's ids, by their hash; each is one entry of its state.
SHARES = 1024


class Purchases(StatefulProcessor):
    """Events (event_id, kind, full, at) of one key in; what became of each out.

    recorded: the first purchase; known: another one; revoked: a full refund of a recorded purchase; noted: a partial refund;
    waiting: a full refund before its purchase; duplicate: an id seen before; expired: a refund that waited in vain.
    revoked_at is the first revocation's time once there is one.

    State is asked once for each share of ids that a trigger touches, not for each event, and a key has a timer for what is due first.
    """

    def __init__(self, key: str, remember_days: int, patience_days: int):
        self.key, self.remember_ms, self.patience_ms = key, remember_days * _DAY_MS, patience_days * _DAY_MS

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.purchase = handle.getValueState("purchase", "at long, revoked_at long")
        self.seen = handle.getMapState("seen", "share int", "ids array<string>, at array<bigint>")
        self.waiting = handle.getListState("waiting", "event_id string, at long")
        self.due = handle.getValueState("due", "at long")

    def _rows(self, key: tuple, ids: Any, at: Any, outcomes: Any) -> pd.DataFrame:
        bought = self.purchase.get() if self.purchase.exists() else None
        out = pd.DataFrame({"event_id": ids, "at": at, "outcome": outcomes})
        out.insert(0, self.key, key[0])
        out["at"] = pd.to_datetime(out["at"], unit="us")
        out["revoked_at"] = pd.to_datetime(pd.Series([bought[1] if bought else None] * len(out), dtype="Int64"), unit="us")
        return out

    def _wake(self, at_ms: int | None) -> None:
        """See to it that the key is looked at by ``at_ms``; an earlier timer that is pending is enough."""
        pending = self.due.get()[0] if self.due.exists() else None
        if at_ms is not None and (pending is None or at_ms < pending):
            self.handle.registerTimer(at_ms)
            self.due.update((at_ms,))

    def _first_seen(self, ids: pd.Series, at: np.ndarray) -> np.ndarray:
        """True for events with an id that is new in the key and in the trigger; new ids are kept."""
        fresh = ~ids.duplicated().to_numpy()
        own = pd.DataFrame({"id": ids.to_numpy(), "at": at, "share": pd.util.hash_array(ids.fillna("").to_numpy(object)) % SHARES, "k": np.arange(len(ids))})[fresh]
        for share, rows in own.groupby("share", sort=False):
            held = self.seen.getValue((int(share),)) if self.seen.containsKey((int(share),)) else ([], [])
            old = rows["id"].isin(held[0]).to_numpy()
            fresh[rows["k"].to_numpy()[old]] = False
            new = rows[~old]
            if len(new):
                self.seen.updateValue((int(share),), ([*held[0], *new["id"]], [*held[1], *map(int, new["at"])]))
        return fresh

    def _outcomes(self, ids: np.ndarray, bought_by: np.ndarray, full: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What becomes of new events in the order of time, and the purchase and waiting refunds after them."""
        bought = self.purchase.get() if self.purchase.exists() else None
        first = -1 if bought else int(np.argmax(bought_by)) if bought_by.any() else len(ids)
        place, refund = np.arange(len(ids)), ~bought_by & full
        out = np.where(bought_by, np.where(place == first, "recorded", "known"), np.where(~full, "noted", np.where(place < first, "waiting", "revoked"))).astype(object)
        early, late = at[refund & (place < first)], at[refund & (place > first)]
        if first == len(ids):  # no purchase yet
            if len(early):
                self.waiting.appendList([(ids[k], int(at[k])) for k in np.flatnonzero(refund)])
                self._wake(int(early.min()) // 1000 + self.patience_ms)
            return out
        revoked = bought[1] if bought else None
        if not bought and self.waiting.exists():
            revoked = next(iter(self.waiting.get()))[1]
            self.waiting.clear()
        for times in (early, late):
            if revoked is None and len(times):
                revoked = int(times[0])
        if not bought or revoked != bought[1]:
            self.purchase.update((bought[0] if bought else int(at[first]), revoked))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        page = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable").reset_index(drop=True)
        at = page["at"].astype("datetime64[us]").astype("int64").to_numpy()
        ids, outcomes = page["event_id"].to_numpy(object), np.full(len(page), "duplicate", object)
        fresh = self._first_seen(page["event_id"], at)
        if fresh.any():
            full = page["full"].astype("boolean").fillna(False).to_numpy(bool)
            outcomes[fresh] = self._outcomes(ids[fresh], (page["kind"] == "purchase").to_numpy(bool)[fresh], full[fresh], at[fresh])
            self._wake(int(at[fresh].min()) // 1000 + self.remember_ms)
        yield self._rows(key, ids, at, outcomes)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        pending = self.due.get()[0] if self.due.exists() else None
        if pending is not None and pending > now:
            return  # a timer that an earlier one made needless
        now = max(now, timerValues.getCurrentWatermarkInMs() - 1)
        ends = []
        for share, (ids, times) in list(self.seen.iterator()):
            kept = [k for k, at in enumerate(times) if at // 1000 + self.remember_ms > now]
            ends += [times[k] // 1000 + self.remember_ms for k in kept]
            if not kept:
                self.seen.removeKey(share)
            elif len(kept) < len(ids):
                self.seen.updateValue(share, ([ids[k] for k in kept], [times[k] for k in kept]))
        held = list(self.waiting.get()) if self.waiting.exists() else []
        kept = [x for x in held if x[1] // 1000 + self.patience_ms > now]
        ends += [x[1] // 1000 + self.patience_ms for x in kept]
        self.due.clear()
        self._wake(min(ends, default=None))
        if len(kept) < len(held):
            self.waiting.clear()
            if kept:
                self.waiting.put([tuple(x) for x in kept])
            gone = [x for x in held if x[1] // 1000 + self.patience_ms <= now]
            yield self._rows(key, [x[0] for x in gone], [x[1] for x in gone], ["expired"] * len(gone))


def purchases(events: DataFrame, key: str = "key", late: str = "1 day", remember_days: int = 30, patience_days: int = 90) -> DataFrame:
    """A stream of what became of each event of ``events`` (key string, event_id string, kind purchase or refund, full, at timestamp).

    Columns key, event_id, at, outcome and revoked_at. A key's events of one trigger are taken by time as a whole. Ids are remembered for
    ``remember_days`` and refunds wait for ``patience_days`` of event time; events more than ``late`` behind the newest are dropped. The
    session's state store must keep timers (``keep_state``).
    """
    own = events.select(key, "event_id", "kind", "full", "at").withWatermark("at", late)
    schema = f"{key} string, event_id string, at timestamp, outcome string, revoked_at timestamp"
    return own.groupBy(key).transformWithStateInPandas(Purchases(key, remember_days, patience_days), schema, "append", "eventtime")
