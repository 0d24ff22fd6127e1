"""Slots within a batch, and purchases as keyed state: replays, events out of order, restarts and expiry."""

import random

import pytest

from pagewright.operators import service
from pagewright.streaming import events as E
from pagewright.streaming import purchases as P

PURCHASES = [("k", "paid", None, "1.2"), ("r", "paid", 5, "1.0"), ("o", "open", None, "1.0"), ("m", "paid", None, "1.0")]


def tables(spark, held, requests):
    return (
        spark.createDataFrame(PURCHASES, "key string, status string, revoked_at int, version string"),
        spark.createDataFrame(held, "key string, device string, deactivated_at int"),
        spark.createDataFrame(requests, "request_id int, key string, device string, version string, at int"),
    )


def test_slots_of_one_batch(spark):
    bought, held, asked = tables(spark, [("k", "d0", None), ("k", "old", 3)], [(1, "k", "a", "1.9", 1), (2, "k", "b", "1.9", 2), (3, "k", "c", "1.9", 3), (4, "k", "a", "1.9", 4), (5, "k", "d0", "1.9", 5), (6, "k", "old", "1.9", 6), (7, "k", "a", "2.0", 0)])
    got = {r["request_id"]: (r["state"], r["active"]) for r in service.allocated(bought, held, asked, limit=2).collect()}
    full = "ACTIVATION_LIMIT_REACHED"
    assert got == {1: ("ACTIVE", 2), 2: (full, 2), 3: (full, 2), 4: ("ACTIVE", 2), 5: ("ACTIVE", 2), 6: (full, 2), 7: ("ENTITLEMENT_MISMATCH", 1)}


def test_slots_against_one_request_after_the_other(spark):
    rng = random.Random(3)
    held = [("k", f"d{i}", None if i < 2 else 1) for i in range(4)] + [("m", "d9", None)]
    requests = [(i, rng.choice(["k", "k", "m", "r", "o", "x", None]), rng.choice([*(f"d{j}" for j in range(12)), None]), rng.choice(["1.1", "1.1", "2.0", None]), rng.randrange(40)) for i in range(300)]
    bought, active, asked = tables(spark, held, requests)
    for limit in (1, 5):
        now = {(k, d) for k, d, gone in held if gone is None}
        want = {}
        for i, k, d, v, _ in sorted(requests, key=lambda x: (x[4], x[0])):
            own = next((x for x in PURCHASES if x[0] == k), None)
            count = sum(x == k for x, _ in now)
            if own is None or own[1] != "paid":
                state = "INVALID"
            elif own[2]:
                state = "REVOKED"
            elif v is None or v.split(".")[0] != own[3].split(".")[0]:
                state = "ENTITLEMENT_MISMATCH"
            elif (k, d) in now or (d is not None and count < limit):
                now.add((k, d))
                state = "ACTIVE"
            else:
                state = "ACTIVATION_LIMIT_REACHED"
            want[i] = state, sum(x == k for x, _ in now)
        answers = service.allocated(bought, active, asked, limit)
        assert {r["request_id"]: (r["state"], r["active"]) for r in answers.collect()} == want
        after = service.activated(active, answers).filter("deactivated_at is null").collect()
        assert {(r["key"], r["device"]) for r in after} == now
    assert service.allocated(bought, active, asked.limit(0)).count() == 0


SCHEMA = "key string, event_id string, kind string, full boolean, at timestamp"


@pytest.fixture
def runs(spark, tmp_path):
    """Adds rows to a stream's input, runs it from its checkpoint, and gives what it has put out so far."""
    P.keep_state(spark)

    def run(rows, **options):
        spark.createDataFrame([(k, i, kind, full, at) for k, i, kind, full, at in rows], "key string, event_id string, kind string, full boolean, at string").selectExpr("key", "event_id", "kind", "full", "timestamp(at) as at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = P.purchases(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), **options)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["key"], r["event_id"], r["outcome"], str(r["revoked_at"])[5:16] if r["revoked_at"] else None) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    return run


def test_refund_before_purchase_and_replay(runs):
    first = runs([("a", "r1", "refund", True, "2024-01-02"), ("b", "p1", "purchase", None, "2024-01-01"), ("b", "r2", "refund", False, "2024-01-03")], late="9 days")
    assert first == [("a", "r1", "waiting", None), ("b", "p1", "recorded", None), ("b", "r2", "noted", None)]
    second = runs([("a", "p2", "purchase", None, "2024-01-04"), ("a", "r1", "refund", True, "2024-01-02"), ("b", "r3", "refund", True, "2024-01-05"), ("b", "r4", "refund", True, "2024-01-06"), ("b", "p1", "purchase", None, "2024-01-05"), ("b", "p9", "purchase", None, "2024-01-05")], late="9 days")
    assert sorted(set(second) - set(first)) == [
        ("a", "p2", "recorded", "01-02 00:00"), ("a", "r1", "duplicate", "01-02 00:00"), ("b", "p1", "duplicate", "01-05 00:00"), ("b", "p9", "known", "01-05 00:00"), ("b", "r3", "revoked", "01-05 00:00"), ("b", "r4", "revoked", "01-05 00:00"),
    ]


def test_old_refunds_and_ids_go(runs):
    options = {"late": "1 day", "remember_days": 5, "patience_days": 10}
    runs([("a", "r1", "refund", True, "2024-01-01"), ("c", "p1", "purchase", None, "2024-01-01")], **options)
    runs([("z", "p0", "purchase", None, "2024-02-01")], **options)  # the watermark goes on
    after = runs([("a", "p2", "purchase", None, "2024-02-01"), ("c", "p1", "purchase", None, "2024-02-01")], **options)
    assert ("a", "r1", "expired", None) in after and ("a", "p2", "recorded", None) in after
    assert ("c", "p1", "known", None) in after  # its id is forgotten, its purchase isn't


def test_ingested_once_over_restarts(spark, tmp_path):
    for ids in (["a", "b", "a"], ["b", "c"], ["c", "a", "d"]):
        spark.createDataFrame([(x,) for x in ids], "id string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id string").parquet(f"{tmp_path}/in")
        E.ingested(stream, "id", f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c", "d"]


def test_state_is_asked_by_share_not_by_event():
    """A key's trigger of many events: few calls, and the same outcomes as one event after the other."""
    calls = []

    class Held:
        def __init__(self):
            self.value, self.map, self.list = None, {}, []

        def exists(self):
            calls.append("exists")
            return self.value is not None or bool(self.list)

        def get(self):
            calls.append("get")
            return iter(self.list) if self.list else self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            self.value, self.list = None, []

        def appendList(self, rows):  # noqa: N802
            calls.append("append")
            self.list += rows

        def containsKey(self, key):  # noqa: N802
            calls.append("contains")
            return key in self.map

        def getValue(self, key):  # noqa: N802
            calls.append("value")
            return self.map[key]

        def updateValue(self, key, value):  # noqa: N802
            calls.append("put")
            self.map[key] = value

    class Handle:
        getValueState = getMapState = getListState = lambda self, *_: Held()

        def registerTimer(self, at):  # noqa: N802
            calls.append("timer")

    import pandas as pd

    rng = random.Random(8)
    for trial in range(30):
        own = P.Purchases("key", 30, 90)
        own.init(Handle())
        seen, bought, waiting, revoked = set(), None, [], None
        for _ in range(3):
            n = 5000 if trial == 0 else rng.randrange(1, 12)
            rows = [(f"e{rng.randrange(9000 if trial == 0 else 25)}", "purchase" if rng.random() < (0.0002 if trial == 0 else 0.15) else "refund", rng.choice([True, True, False, None]), rng.randrange(50)) for _ in range(n)]
            page = pd.DataFrame(rows, columns=["event_id", "kind", "full", "at"])
            page["at"] = pd.to_datetime(page["at"], unit="D")
            calls.clear()
            (out,) = own.handleInputRows(("k",), iter([page[: n // 2], page[n // 2 :]]), None)
            assert len(calls) <= 3 * P.SHARES + 20
            want = []
            for id_, kind, full, at in sorted(rows, key=lambda r: (r[3], r[0])):
                if id_ in seen:
                    what = "duplicate"
                elif kind == "purchase":
                    what = "known" if bought else "recorded"
                    if not bought:
                        bought, revoked, waiting = True, waiting[0] if waiting else None, []
                elif not full:
                    what = "noted"
                elif not bought:
                    what = "waiting"
                    waiting.append(at)
                else:
                    what, revoked = "revoked", at if revoked is None else revoked
                seen.add(id_)
                want.append((id_, what))
            assert list(zip(out["event_id"], out["outcome"], strict=True)) == want
            assert set(out["revoked_at"].dropna()) == ({pd.Timestamp(revoked, unit="D")} if revoked is not None else set())
