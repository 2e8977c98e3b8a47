"""Typed state, deltas and the change log, with stops and replays."""

import random
import time

import pytest
from judgelake import constants as K
from judgelake.operators import changes as CH
from judgelake.session import scratch_path
from judgelake.streaming import deltas, jobs
from judgelake.streaming.early_finish import stream_early_finish

CASES = ("submission_id long, ordinal long, total long, has_expected boolean, status string, time_used long, message string")


@pytest.fixture
def base(spark, request):
    return scratch_path(spark, f"test-{request.node.name}-{random.random()}")


def feed(spark, base, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/src")


def finish(spark, base, **kw):
    s = spark.readStream.schema(CASES).option("maxFilesPerTrigger", 1).parquet(f"{base}/src")
    q = jobs.run_available(stream_early_finish(s, **kw).writeStream.format("parquet").option("path", f"{base}/sink"), f"{base}/ckpt", 90)
    return q, sorted(tuple(r) for r in spark.read.parquet(f"{base}/sink").collect())


def case(sub, ordinal, total, status=K.ACCEPTED, expected=True, t=5):
    return (sub, ordinal, total, expected, status, t, f"m{ordinal}")


def test_early_finish_over_stops_and_replays(spark, base):
    feed(spark, base, [case(1, 2, 3, K.WRONG_ANSWER), case(2, 1, 2), case(3, 3, 3, t=9), case(4, 1, 4, expected=False), case(5, 1, 1, t=None)], CASES)
    _, got = finish(spark, base)
    assert got == [(5, K.ACCEPTED, 0, 100, "Passed 1/1 test cases", 0)]  # 1 waits for its first case
    feed(spark, base, [case(1, 1, 3), case(2, 1, 2), case(3, 1, 3), case(4, 3, 4), case(4, 2, 4, K.RUNTIME_ERROR)], CASES)
    feed(spark, base, [case(1, 3, 3), case(2, 2, 2, t=7), case(3, 2, 3), case(4, 4, 4), case(5, 1, 1, K.WRONG_ANSWER)], CASES)
    _, got = finish(spark, base)
    want = [(1, K.WRONG_ANSWER, 5, 33, "m2", 2), (2, K.ACCEPTED, 7, 100, "Passed 2/2 test cases", 0),
            (3, K.ACCEPTED, 9, 100, "Passed 3/3 test cases", 0), (4, K.RUNTIME_ERROR, 5, 0, "m2", 2),
            (5, K.ACCEPTED, 0, 100, "Passed 1/1 test cases", 0)]
    assert got == want
    feed(spark, base, [case(k, 1, 3, K.WRONG_ANSWER) for k in range(1, 6)], CASES)  # late rows change nothing
    q, got = finish(spark, base)
    assert got == want
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 5  # a value and a timer each, no waiting cases


def test_early_finish_forgets_what_is_over(spark, base):
    feed(spark, base, [case(1, 1, 1), case(2, 2, 2)], CASES)
    _, got = finish(spark, base, keep_closed_ms=1, keep_idle_ms=1)
    assert [r[0] for r in got] == [1]
    time.sleep(1)
    feed(spark, base, [case(9, 1, 1)], CASES)  # timers run with the next batch
    finish(spark, base, keep_closed_ms=1, keep_idle_ms=1)
    time.sleep(1)
    feed(spark, base, [case(2, 1, 2), case(8, 1, 1)], CASES)
    q, got = finish(spark, base, keep_closed_ms=1, keep_idle_ms=1)
    assert [r[0] for r in got] == [1, 8, 9]  # the second case of 2 was dropped with its idle state
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 2


STATUS = "submission_id long, seq long, ts long, status string"


def test_status_deltas_follow_the_batch(spark, base):
    def run():
        s = spark.readStream.schema(STATUS).option("maxFilesPerTrigger", 1).parquet(f"{base}/src")
        out = jobs.stream_submission_status(s)
        jobs.run_available(out.writeStream.outputMode("update").foreachBatch(
            deltas.sink(f"{base}/table", ["submission_id"], out.schema, 3)), f"{base}/ckpt", 90)
        return {r.submission_id: r.status for r in deltas.latest(spark, f"{base}/table", ["submission_id"], out.schema).collect()}
    feed(spark, base, [(k, k, k, K.PENDING) for k in range(500)], STATUS)
    assert run() == dict.fromkeys(range(500), K.PENDING)
    feed(spark, base, [(7, 900, 900, K.JUDGING), (7, 901, 901, K.ACCEPTED), (8, 0, 0, K.JUDGING)], STATUS)
    got = run()
    assert got == {**dict.fromkeys(range(500), K.PENDING), 7: K.ACCEPTED, 8: K.PENDING}
    assert spark.read.parquet(f"{base}/table/delta/batch=1").count() == 2
    feed(spark, base, [(9, 902, 902, K.ACCEPTED)], STATUS)
    assert run() == {**got, 9: K.ACCEPTED}
    assert deltas.state_of(spark, f"{base}/table") == (2, [])  # three deltas were folded
    assert len(deltas.vacuum(spark, f"{base}/table")) == 3
    feed(spark, base, [(10, 903, 903, K.ACCEPTED)], STATUS)
    assert run() == {**got, 9: K.ACCEPTED, 10: K.ACCEPTED}
    assert deltas.state_of(spark, f"{base}/table") == (2, [3])


def test_deltas_survive_stopped_writes_and_replays(spark, base):
    schema = "k long, v long"

    def put(rows, batch):
        return deltas.append(spark.createDataFrame(rows, schema).coalesce(1), batch, base)

    def table():
        return {r.k: r.v for r in deltas.latest(spark, base, ["k"], schema).collect()}
    assert table() == {}
    put([(1, 1), (2, 1)], 0)
    put([(1, 2)], 1)
    put([(1, 3), (3, 3)], 1)  # the batch comes again
    assert table() == {1: 3, 2: 1, 3: 3}
    spark.createDataFrame([(1, 99)], schema).coalesce(1).write.parquet(f"{base}/delta/batch=2")
    fs, p = deltas._folder(spark, f"{base}/delta/batch=2/_SUCCESS")
    fs.delete(p, False)  # a write that did not end
    assert table() == {1: 3, 2: 1, 3: 3}
    assert deltas.compact(spark, base, lambda: deltas.latest(spark, base, ["k"], schema)) == 1
    assert not put([(1, 77)], 0) and table() == {1: 3, 2: 1, 3: 3}  # the snapshot has it
    put([(2, 5)], 2)
    assert table() == {1: 3, 2: 5, 3: 3}


def in_order(table, log):
    """M1-M3 one by one on a dict; (table, rejected (id, seq))."""
    t, lost = {k: dict(v) for k, v in table.items()}, []
    for c in sorted(log, key=lambda c: c["seq"]):
        row = t.get(c["id"])
        if c["op"] == "upsert":
            t[c["id"]] = {**{f: c[f] for f in (*CH.FIELDS, "has_checker")}, "created_at": row["created_at"] if row else c["created_at"]}
        elif c["op"] == "delete":
            t.pop(c["id"], None)
        elif row is None:
            lost.append((c["id"], c["seq"]))
        else:
            row.update({f: c[f] for f in CH.FIELDS if c[f] is not None})
            row["has_checker"] = row["has_checker"] or bool(c["checker_set"])
    return t, lost


def random_log(rng, n, ids):
    def some(*v):
        return rng.choice([None, *v])
    out = []
    for seq in rng.sample(range(10 * n), n):
        op = rng.choice(["upsert", "patch", "patch", "delete"])
        up = op == "upsert"
        out.append(dict(id=rng.choice(ids), seq=seq, op=op, title=rng.choice("abc") if up else some("x", "y"),
                        time_limit=rng.randint(1, 9) if up else some(10, 20), memory_limit=1 if up else some(2, 3),
                        has_checker=rng.random() < 0.3 if up else None, test_case_count=rng.randint(0, 5) if up else some(7),
                        created_at=1000 + seq if up else None, checker_set=None if up else some(True, False)))
    return out


def test_fold_equals_the_changes_in_order(spark):
    rng = random.Random(6)
    ids = [f"p{k}" for k in range(12)]
    log = random_log(rng, 300, ids) + random_log(rng, 3, ["only"])
    table = {f"p{k}": dict(title="t", time_limit=1, memory_limit=2, test_case_count=3, has_checker=k % 2 == 0, created_at=k) for k in range(6)}
    names = CH.CHANGE.replace(",", "").split()[::2]
    t = spark.createDataFrame([(k, v["title"], v["time_limit"], v["memory_limit"], v["has_checker"], v["test_case_count"], v["created_at"])
                               for k, v in table.items()], CH.TABLE)
    want, lost = in_order(table, log)

    def frame(rows):
        return spark.createDataFrame([tuple(c[n] for n in names) for c in rows], CH.CHANGE)

    def as_dict(df):
        return {r.id: {k: v for k, v in r.asDict().items() if k != "id"} for r in df.collect()}
    assert as_dict(CH.apply_changes(t, CH.fold_changes(frame(log)))) == want
    got = CH.rejected_patches(t, frame(log)).collect()
    assert sorted((r.id, r.seq) for r in got) == sorted(lost) and lost
    by_seq = sorted(log, key=lambda c: c["seq"])
    for cut in (1, 60, 150, 302):  # one batch after the other
        step = CH.apply_changes(t, CH.fold_changes(frame(by_seq[:cut])))
        assert as_dict(CH.apply_changes(step, CH.fold_changes(frame(by_seq[cut:])))) == want
    assert as_dict(CH.apply_changes(t, CH.fold_changes(frame(log).limit(0)))) == table


def test_registry_stream_over_restarts(spark, base):
    rng = random.Random(7)
    log = random_log(rng, 120, ["a", "b", "c", "d"])
    table = {"a": dict(title="t", time_limit=1, memory_limit=2, test_case_count=3, has_checker=False, created_at=1)}
    initial = spark.createDataFrame([("a", "t", 1, 2, False, 3, 1)], CH.TABLE)
    names = CH.CHANGE.replace(",", "").split()[::2]
    by_seq = sorted(log, key=lambda c: c["seq"])
    for lo in range(0, 120, 30):
        feed(spark, base, [tuple(c[n] for n in names) for c in by_seq[lo:lo + 30]], CH.CHANGE)
        s = spark.readStream.schema(CH.CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{base}/src")
        jobs.stream_registry_changes(s, f"{base}/table", initial, f"{base}/ckpt", compact_every=3).awaitTermination()
        want, _ = in_order(table, by_seq[:lo + 30])
        got = {r.id: {k: v for k, v in r.asDict().items() if k != "id"} for r in jobs.registry_now(spark, f"{base}/table").collect()}
        assert got == want
    assert deltas.state_of(spark, f"{base}/table")[0] == 2
    assert spark.read.parquet(f"{base}/table/delta/batch=3").count() == 30


def test_early_finish_asks_its_state_seldom():
    """One read and one write of the progress; a waiting case is fetched without a question before it."""
    from judgelake.streaming.early_finish import EarlyFinish
    from pyspark.sql import Row

    calls = []

    class State:
        def __init__(self, *_):
            self.held = {}

        def __getattr__(self, name):
            def call(*a):
                calls.append(name)
                if name in ("get", "getValue"):
                    return self.held.get(a[0] if a else None)
                if name in ("update", "updateValue"):
                    self.held[a[0] if len(a) > 1 else None] = a[-1]
                if name == "removeKey":
                    self.held.pop(a[0])
                return name == "containsKey" and a[0] in self.held
            return call

    class Handle:
        getValueState = getMapState = lambda self, *_: State()

        def registerTimer(self, at):
            pass

    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 0
    p = EarlyFinish(10, 10)
    p.init(Handle())

    def case(o):
        return Row(ordinal=o, total=3, has_expected=True, status="Accepted", time_used=o, message="m")
    assert list(p.handleInputRows((7,), iter([case(2)]), Now())) == []
    del calls[:]
    out = list(p.handleInputRows((7,), iter([case(1), case(3)]), Now()))
    assert [(r.submission_id, r.status, r.time_used, r.failed_case) for r in out] == [(7, "Accepted", 3, 0)]
    assert calls == ["get", "getValue", "removeKey", "update"]


def test_buckets_close_as_single_submissions_do():
    """Random batches with repeats, gaps, nulls and late rows: equal results, one read and one write per batch."""
    import pyarrow as pa
    import pandas as pd
    from judgelake.streaming import early_finish as EF
    from pyspark.sql import Row

    asked = []

    class Value:
        value = None

        def get(self):
            asked.append("get")
            return self.value

        def update(self, v):
            asked.append("update")
            self.value = v

        def clear(self):
            self.value = None

    class Map(dict):
        containsKey, getValue, removeKey, updateValue = dict.__contains__, dict.get, dict.__delitem__, dict.__setitem__

    class Handle:
        getValueState = lambda self, *_: Value()
        getMapState = lambda self, *_: Map()
        registerTimer = deleteTimer = lambda self, at: None

    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 7
    names = EF.ARRIVED.names
    rng = random.Random(11)
    bulk, single = EF.BulkEarlyFinish(10, 10), {k: EF.EarlyFinish(10, 10) for k in range(200)}
    for p in (bulk, *single.values()):
        p.init(Handle())
    size = {k: rng.randint(0, 6) for k in single}
    got, want = {}, {}
    for _ in range(12):
        rows = []
        for _ in range(150):
            k = rng.randrange(200)
            status = rng.choice([K.ACCEPTED] * 8 + [K.WRONG_ANSWER, None])
            rows.append(dict(submission_id=k, ordinal=rng.randint(1, max(1, size[k])), total=size[k], has_expected=rng.random() < 0.9, status=status,
                             time_used=rng.choice([None, (1 << 60) + 1, 3, -4]), message=rng.choice([None, "m", "é"])))
        for k in {r["submission_id"] for r in rows}:
            mine = [Row(**r) for r in rows if r["submission_id"] == k]
            want |= {r.submission_id: tuple(r) for r in single[k].handleInputRows((k,), iter(mine), Now())}
        packs = [EF._packed(pa.Table.from_pylist([{n: r[n] for n in names} for r in part], EF.ARRIVED), None) for part in (rows[:70], rows[70:])]
        del asked[:]
        for out in bulk.handleInputRows((0,), iter([pd.DataFrame({"rows": packs})]), Now()):
            for r in out.astype(object).where(out.notna(), None).itertuples(index=False):
                assert r.submission_id not in got  # once
                got[r.submission_id] = tuple(r)
        assert asked == ["get", "update"]
    assert got == want and len({r[1] for r in want.values()}) == 3 and len(want) > 150


def test_early_finish_state_is_a_value_per_bucket(spark, base):
    feed(spark, base, [case(None if k == 7 else k, 1, 1 + k % 2) for k in range(3000)], CASES)
    q, got = None, None
    s = spark.readStream.schema(CASES).parquet(f"{base}/src")
    q = jobs.run_available(stream_early_finish(s).writeStream.format("parquet").option("path", f"{base}/sink"), f"{base}/ckpt", 90)
    got = [r.submission_id for r in spark.read.parquet(f"{base}/sink").collect()]
    assert sorted(got, key=str) == sorted(range(0, 3000, 2), key=str)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 1025  # 6,000 with a value and a timer for each submission
    feed(spark, base, [case(None, 2, 2)], CASES)
    jobs.run_available(stream_early_finish(s).writeStream.format("parquet").option("path", f"{base}/sink"), f"{base}/ckpt", 90)
    assert [r.submission_id for r in spark.read.parquet(f"{base}/sink").collect()].count(None) == 1
