"""Event streams: idempotent ingest, refunds, and rate limits by state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.service import ATTEMPTS, WINDOW_S, refunded

#: The kinds of events that have an effect.
ACCEPTED = ["checkout.session.completed", "checkout.session.async_payment_succeeded", "charge.refunded"]


def accepted(events: DataFrame, kind: str = "type", kinds: list[str] | None = None) -> DataFrame:
    """The events with an effect; others are acknowledged by being dropped."""
    return events.filter(F.col(kind).isin(ACCEPTED if kinds is None else kinds))


def once(events: DataFrame, id: str, at: str, within: str = "7 days") -> DataFrame:
    """A stream with each id once, remembering ids for ``within`` of event time, so that state stays bounded."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([id])


def ingest(path: str, id: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that writes each batch to a folder of its own, so that a batch that runs again replaces what it left.

    It reads nothing that was written before: that ids come once over batches is the stream's state's work (``ingested``).
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates([id]).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return sink


def ingested(events: DataFrame, id: str, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream to be started that writes the rows of ``events`` with new ids under ``path``, each id once.

    Ids are state by key: a task holds those of its share, and a batch looks up its own ids only. They are kept for good, as
    replays may come at any time; ``once`` forgets them after some event time.
    """
    return events.dropDuplicates([id]).writeStream.foreachBatch(ingest(path, id)).option("checkpointLocation", checkpoint)


def refund(purchases: DataFrame, batch: DataFrame) -> DataFrame:
    """Purchases after a batch of refund events (key, amount, total, at): one that covers the total is full."""
    return refunded(purchases, batch.select("key", (F.col("amount") >= F.col("total")).alias("full"), "at"))


def limited(attempts: DataFrame, key: str, at: str, allowed: int = ATTEMPTS, window_s: int = WINDOW_S, late: str = "1 hour") -> DataFrame:
    """A stream of attempts (key string, at timestamp) with ``allowed`` for each, by state of two numbers a key.

    A window starts at the key's first attempt, not at the clock, and rejected attempts count. A key's attempts of one
    trigger are sorted by time as a whole, so a trigger's size bounds what a task holds. State goes when the watermark,
    ``late`` behind the newest attempt, has passed the window's end, so replaying a stream gives the same answers.
    """

    def step(own: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        page = pd.concat(list(pages)).sort_values(at, kind="stable")
        fine = []
        for moment in page[at].astype("datetime64[us]").astype("int64"):
            if opened is None or moment >= opened + window_s * 1_000_000:
                opened, n = int(moment), 0
            n += 1
            fine.append(n <= allowed)
        yield pd.DataFrame({key: own[0], at: page[at], "allowed": fine})
        state.update((opened, n))
        end = opened // 1000 + window_s * 1000 + 1
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    schema = f"{key} string, {at} timestamp, allowed boolean"
    own = attempts.select(key, at).withWatermark(at, late)
    return own.groupBy(key).applyInPandasWithState(step, schema, "opened long, n long", "append", GroupStateTimeout.EventTimeTimeout)
