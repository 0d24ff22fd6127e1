"""Entitlement tables: purchases, activations and processed events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Activations for each purchase, and attempts for each window of seconds.
ACTIVATIONS, ATTEMPTS, WINDOW_S = 2, 10, 60
#: Days until a licence is looked at again, by how often that failed; the first without failures.
RETRY_DAYS = [30, 1, 3, 7]


def entitlement(status: Column, revoked_at: Column) -> Column:
    """INVALID without a purchase, REVOKED once revoked, ACTIVE when paid."""
    return F.when(status.isNull(), "INVALID").when(revoked_at.isNotNull(), "REVOKED").when(status == "paid", "ACTIVE").otherwise("INVALID")


def looked_up(rows: DataFrame, keys: list[str], table: DataFrame, columns: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` of the first of several keys that ``table`` has, in the order of ``columns``.

    ``columns[i]`` of the table answers ``keys[i]`` of the rows; each is unique there.
    """
    out, found = rows, []
    for i, (key, column) in enumerate(zip(keys, columns, strict=True)):
        side = table.filter(F.col(column).isNotNull()).select(F.col(column).alias(f"_k{i}"), F.struct(F.col(value).alias("v")).alias(f"_v{i}"))
        out = out.join(side, F.col(key) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return out.select(*rows.columns, F.coalesce(*found)["v"].alias(value))


def unseen(events: DataFrame, seen: DataFrame, id: str) -> DataFrame:
    """Events whose id isn't recorded yet, one row for each id."""
    return events.join(seen.select(id), id, "left_anti").dropDuplicates([id])


def event_counts(asked: DataFrame, events: DataFrame, id: str) -> DataFrame:
    """Each asked id with the number of recorded events that have it, 0 where there is none."""
    counts = events.groupBy(id).agg(F.count(F.lit(1)).alias("_n"))
    return asked.join(counts, id, "left").select(*asked.columns, F.coalesce("_n", F.lit(0)).alias("events"))


def active_counts(purchases: DataFrame, activations: DataFrame, key: str, limit: int = ACTIVATIONS) -> DataFrame:
    """Each purchase's activations that aren't deactivated, and whether another device fits."""
    counted = activations.filter("deactivated_at is null").groupBy(key).agg(F.count(F.lit(1)).alias("active"))
    active = F.coalesce("active", F.lit(0))
    return purchases.join(counted, key, "left").select(*purchases.columns, active.alias("active"), (active < limit).alias("fits"))


def activate(purchases: DataFrame, activations: DataFrame, requests: DataFrame, limit: int = ACTIVATIONS) -> DataFrame:
    """The state that each request (key, device, version) meets: a request never counts against its own device.

    ENTITLEMENT_MISMATCH is another major version than the purchase's. Requests of one batch are judged alone, against the
    tables as they are.
    """
    counts = active_counts(purchases, activations, "key", limit)
    known = activations.filter("deactivated_at is null").select("key", "device", F.lit(True).alias("known")).distinct()
    own = requests.join(counts.withColumnRenamed("version", "bought"), "key", "left").join(known, ["key", "device"], "left")
    state = entitlement(F.col("status"), F.col("revoked_at"))
    same = F.split("version", r"\.")[0] == F.split("bought", r"\.")[0]
    return own.select(
        "key",
        "device",
        F.when(state != "ACTIVE", state).when(~F.coalesce(same, F.lit(False)), "ENTITLEMENT_MISMATCH").when(F.coalesce("known", "fits"), "ACTIVE").otherwise("ACTIVATION_LIMIT_REACHED").alias("state"),
    )


#: Shares that a key's new devices are ranked in first.
SHARES = 16


def allocated(purchases: DataFrame, activations: DataFrame, requests: DataFrame, limit: int = ACTIVATIONS) -> DataFrame:
    """The state that each request (request_id, key, device, version, at) of a batch meets, in order of at and request_id, and ``active``, the devices active right after it.

    A device that is active already, or becomes so by an earlier request of the batch, needs no slot; free slots go to new
    devices in the order of their first fitting request. So a device's answer is that of its first fitting request: one
    aggregation finds those, and a key's first ones are ranked within shares and then over them, so that a key with most
    of the requests is no task's burden. Equal requests are answered alike; those of unknown keys are INVALID.
    """
    held = activations.filter("deactivated_at is null").select("key", "device").distinct()
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("before"))
    known = purchases.select("key", entitlement(F.col("status"), F.col("revoked_at")).alias("entitled"), F.col("version").alias("bought")).join(counts, "key", "left")
    own = requests.select("request_id", "key", "device", "version", "at").join(known, "key", "left").join(held.withColumn("held", F.lit(True)), ["key", "device"], "left")
    same = F.coalesce(F.split("version", r"\.")[0] == F.split("bought", r"\.")[0], F.lit(False))
    judged = own.withColumn("refused", F.when(F.coalesce("entitled", F.lit("INVALID")) != "ACTIVE", F.coalesce("entitled", F.lit("INVALID"))).when(~same, "ENTITLEMENT_MISMATCH"))
    judged = judged.withColumn("before", F.coalesce("before", F.lit(0)))
    asked = judged.filter("refused is null and held is null and device is not null").groupBy("key", "device").agg(F.min(F.struct("at", "request_id")).alias("first"), F.first("before").alias("before"))
    order = Window.partitionBy("key", F.pmod(F.xxhash64("device"), F.lit(SHARES))).orderBy("first", "device")
    some = asked.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= limit)
    slots = some.withColumn("slot", F.col("before") + F.row_number().over(Window.partitionBy("key").orderBy("first", "device"))).filter(F.col("slot") <= limit)
    given = slots.groupBy("key").agg(F.array_sort(F.collect_list("first")).alias("given"))  # at most as many as the limit
    answers = judged.join(slots.select("key", "device", "slot"), ["key", "device"], "left").join(given, "key", "left")
    taken = F.size(F.filter(F.coalesce("given", F.array().cast(dict(slots.select(F.array("first").alias("x")).dtypes)["x"])), lambda x: x <= F.struct("at", "request_id")))
    state = F.coalesce("refused", F.when(F.col("held") | F.col("slot").isNotNull(), "ACTIVE"), F.lit("ACTIVATION_LIMIT_REACHED"))
    return answers.select("request_id", "key", "device", state.alias("state"), (F.col("before") + taken).cast("long").alias("active"))


def activated(activations: DataFrame, answers: DataFrame) -> DataFrame:
    """key, device and deactivated_at of the activations after a batch: devices that were answered ACTIVE are inserted or active again."""
    new = answers.filter("state = 'ACTIVE'").select("key", "device").distinct()
    kept = activations.select("key", "device", "deactivated_at").join(new, ["key", "device"], "left_anti")
    return kept.unionByName(new.withColumn("deactivated_at", F.lit(None).cast(dict(activations.dtypes)["deactivated_at"])))


def verified(activations: DataFrame, purchases: DataFrame, requests: DataFrame) -> DataFrame:
    """The state that each request (activation_id, token) to verify meets: INVALID unless the token's SHA-256 is the active activation's.

    ``activations`` has activation_id, key, token_hash and deactivated_at.
    """
    own = requests.join(activations.select("activation_id", "key", "token_hash", "deactivated_at"), "activation_id", "left").join(purchases.select("key", "status", "revoked_at"), "key", "left")
    known = F.coalesce((F.sha2("token", 256) == F.col("token_hash")) & F.col("deactivated_at").isNull(), F.lit(False))
    return own.select("activation_id", F.when(known, entitlement(F.col("status"), F.col("revoked_at"))).otherwise("INVALID").alias("state"))


def deactivated(activations: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Activations after requests (activation_id, token, at) to deactivate, and each request's state: NOT_ACTIVATED or INVALID."""
    own = requests.join(activations.select("activation_id", "token_hash", F.col("deactivated_at").alias("_was")), "activation_id", "left")
    known = F.coalesce((F.sha2("token", 256) == F.col("token_hash")) & F.col("_was").isNull(), F.lit(False))
    answers = own.select("activation_id", "at", F.when(known, "NOT_ACTIVATED").otherwise("INVALID").alias("state"))
    first = answers.filter("state = 'NOT_ACTIVATED'").groupBy("activation_id").agg(F.min("at").alias("_at"))
    after = activations.join(first, "activation_id", "left").withColumn("deactivated_at", F.coalesce("deactivated_at", "_at")).drop("_at")
    return after, answers.select("activation_id", "state")


def revalidated(state: Column, failures: Column, code: Column, valid: Column, answer: Column) -> Column:
    """State and failures after one look at the server: only its exact answers change the state, all else counts as a failure."""
    told = lambda c, v, a: F.coalesce((code == c) & (valid == F.lit(v)) & (answer == a), F.lit(False))
    active, invalid, revoked = told(200, True, "ACTIVE"), told(401, False, "INVALID"), told(403, False, "REVOKED")
    after = F.when(invalid, "INVALID").when(revoked, "REVOKED").otherwise(state)
    return F.struct(after.alias("state"), F.when(active, 0).when(invalid | revoked, failures).otherwise(failures + 1).cast("long").alias("failures"))


def revalidations(looks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """State and failures of each key after its looks (code, valid, answer) in order, from ACTIVE without failures.

    The first answer of INVALID or REVOKED ends it, and failures count from the last success before: aggregations all.
    """
    one = revalidated(F.lit("ACTIVE"), F.lit(0), F.col("code"), F.col("valid"), F.col("answer"))
    own = looks.withColumn("_one", one).withColumn("_at", F.struct(*order))
    names = [f"_key{i}" for i in range(len(keys))]
    same = F.lit(True)
    for k, name in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(name))

    def by_key(rows: DataFrame, **columns: Column) -> DataFrame:
        return rows.groupBy(*keys).agg(*(c.alias(n) for n, c in columns.items())).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), *columns)

    ended = F.col("_one.state") != "ACTIVE"
    ends = by_key(own, _end=F.min(F.when(ended, F.struct("_at", F.col("_one.state").alias("state")))))
    own = own.join(ends, same).drop(*names)
    before = F.col("_end").isNull() | (F.col("_at") < F.col("_end._at"))
    since = by_key(own.filter(before), _since=F.max(F.when(F.col("_one.failures") == 0, F.col("_at"))))
    own = own.join(since, same, "left").drop(*names)
    failed = before & (F.col("_one.failures") > 0) & (F.col("_since").isNull() | (F.col("_at") > F.col("_since")))
    return own.groupBy(*keys).agg(F.coalesce(F.max("_end.state"), F.lit("ACTIVE")).alias("state"), F.count_if(failed).alias("failures"))


def refunded(purchases: DataFrame, refunds: DataFrame) -> DataFrame:
    """Purchases after refunds (key, full, at): a full one revokes, and the first time of revocation stays."""
    first = refunds.filter("full").groupBy("key").agg(F.min("at").alias("_at"))
    return purchases.join(first, "key", "left").withColumn("revoked_at", F.coalesce("revoked_at", "_at")).drop("_at")


def retry_days(failures: Column) -> Column:
    """Days until the next look: 30 after success, then 1, 3 and 7 by the number of failures."""
    out = F.lit(RETRY_DAYS[-1])
    for n, days in reversed(list(enumerate(RETRY_DAYS[:-1]))):
        out = F.when(failures == n, days).otherwise(out)
    return out


def is_due(now_s: Column, checked_s: Column, failures: Column, jitter_s: Column) -> Column:
    """True once the days since the last look have passed; jitter shifts the look after a success only."""
    wait = retry_days(failures) * 86_400 + F.when(failures == 0, jitter_s).otherwise(0)
    return checked_s.isNull() | (now_s >= checked_s + wait)


def ipv4(text: Column) -> Column:
    """A dotted address as a number; null where it isn't one."""
    parts = F.split(text, r"\.")
    fine = text.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(fine, sum((parts[i].cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0)))


def in_subnets(rows: DataFrame, address: str, subnets: list[str]) -> DataFrame:
    """The rows whose address lies in one of a fixed list of a.b.c.d/n subnets."""
    ranges = []
    for net in subnets:
        base, bits = net.split("/")
        number = sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))
        low = number >> (32 - int(bits)) << (32 - int(bits))
        ranges.append((low, low + (1 << (32 - int(bits))) - 1))
    known = F.broadcast(rows.sparkSession.createDataFrame(ranges, "low long, high long"))
    return rows.withColumn("_ip", ipv4(F.col(address))).join(known, F.col("_ip").between(F.col("low"), F.col("high")), "left_semi").drop("_ip")


def rate_limited(attempts: DataFrame, keys: list[str], at_us: str, tie: str, allowed: int = ATTEMPTS, window_us: int = WINDOW_S * 1_000_000) -> DataFrame:
    """Each attempt (time in microseconds) with its place in its window and whether it is allowed.

    A window starts at a key's first attempt and at the first one at or after the end of the window before; rejected
    attempts count too. Whatever came before, a pause of a window starts anew, so a key's attempts are cut where a
    whole window of the clock has none, and the pieces are scanned side by side; a key that never pauses is one piece.
    """
    own = attempts.select(*keys, at_us, tie).withColumn("_slot", F.floor(F.col(at_us) / window_us))
    slots = own.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_slot")
    starts = F.when(F.col("_slot") - F.lag("_slot").over(w) <= 1, 0).otherwise(1)
    pieces = slots.withColumn("_starts", starts).withColumn("_piece", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    pieces = pieces.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_slot").alias("_of"), "_piece")
    same = F.col("_slot") == F.col("_of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    cut = own.join(pieces, same).select(*keys, at_us, tie, "_piece")
    kinds = dict(own.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, tie)) + ", attempt long, allowed boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened, n = None, None, 0
        for batch in batches:
            at = batch.column(at_us).to_numpy()
            ids = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "_piece")), strict=True))
            place = np.empty(len(at), np.int64)
            begin = 0
            while begin < len(at):
                end = begin + 1 if ids[begin] != ids[-1] else len(at)
                while end < len(at) and ids[end] == ids[begin]:
                    end += 1
                if ids[begin] != key:
                    key, opened, n = ids[begin], None, 0
                while begin < end:  # a step for each window
                    if opened is None or at[begin] >= opened + window_us:
                        opened, n = at[begin], 0
                    upto = begin + int(np.searchsorted(at[begin:end], opened + window_us, "left"))
                    place[begin:upto] = np.arange(n + 1, n + 1 + upto - begin)
                    n, begin = n + upto - begin, upto
            columns = [*(batch.column(c) for c in (*keys, tie)), pa.array(place), pa.array(place <= allowed)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, tie, "attempt", "allowed"])

    return cut.repartition(*keys, "_piece").sortWithinPartitions(*keys, "_piece", at_us, tie).mapInArrow(scan, schema)
