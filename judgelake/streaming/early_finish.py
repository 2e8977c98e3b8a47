"""Close a submission at its first failing case, or when all its cases
are in, once; later rows change nothing.

Known per submission: how far its cases are in without a gap, and the cases
that came before their turn. A case is dropped when the gap before it closes, so
the state is bounded by the open cases. A closed submission keeps one small value
that ignores late rows, until a timer drops it.

``BulkEarlyFinish`` keeps the submissions of a bucket in one value: a micro-batch costs a call, a read and a
write per bucket, whose rows come as tables and are handled as arrays. ``EarlyFinish`` keeps typed state per submission and a row
per waiting case, at several questions to the state store for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from judgelake import constants as K

OUT = "submission_id long, status string, time_used long, score long, message string, failed_case long"
#: next ordinal wanted, passed, longest time, cases waiting, closed, last contact in ms
PROGRESS = "next long, passed long, longest long, waiting long, closed boolean, touched long"
CASE = "has_expected boolean, status string, time_used long, message string"
HOUR_MS = 3_600_000
#: Values the submissions are dealt to by a hash of their id; one more holds that of a null id.
BUCKETS = 1024
#: when the bucket's timer runs, and tables as Arrow streams: closed, open and waiting (below)
BUCKET = "alarm long, closed binary, open binary, waiting binary"
CLOSED = pa.schema([(c, pa.int64()) for c in ("submission_id", "touched")])
OPEN = pa.schema([(c, pa.int64()) for c in ("submission_id", "next", "passed", "longest", "touched")])
WAITING = pa.schema([("submission_id", pa.int64()), ("ordinal", pa.int64()), ("has_expected", pa.bool_()), ("status", pa.string()),
                     ("time_used", pa.int64()), ("message", pa.string())])
ARRIVED = WAITING.append(pa.field("total", pa.int64()))
#: Rows, and bytes of them, that a task holds at most to send them on as one table per bucket.
SENT_ROWS, SENT_BYTES = 1 << 18, 1 << 25
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EarlyFinish(StatefulProcessor):
    def __init__(self, keep_closed_ms: int, keep_idle_ms: int):
        self.keep_closed_ms, self.keep_idle_ms = keep_closed_ms, keep_idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", PROGRESS)
        self.waiting = handle.getMapState("waiting", "ordinal long", CASE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known = self.progress.get()
        if known is None:
            known = (1, 0, 0, 0, False, now)
            self.handle.registerTimer(now + min(self.keep_closed_ms, self.keep_idle_ms))
        want, passed, longest, waiting, closed, _ = known
        if closed:
            for _ in rows:
                pass
            return
        came, total = {}, 0
        for r in rows:
            came[r["ordinal"]] = (bool(r["has_expected"]), r["status"], r["time_used"], r["message"])
            total = r["total"]
        result = None
        while want <= total:
            case = came.pop(want, None)
            if case is None and waiting:
                case = self.waiting.getValue((want,))
                if case is not None:
                    self.waiting.removeKey((want,))
                    waiting -= 1
            if case is None:
                break
            expected, status, time_used, message = case
            if expected and status != K.ACCEPTED:
                result = (status, time_used, passed * 100 // total, message, want)
                break
            if expected:
                passed, longest = passed + 1, max(longest, time_used or 0)
            want += 1
        else:
            result = (K.ACCEPTED, longest, 100, K.MSG_PASSED % (passed, total), 0)
        if result is None:
            for o, case in came.items():
                if o > want:
                    waiting += not self.waiting.containsKey((o,))
                    self.waiting.updateValue((o,), case)
            self.progress.update((want, passed, longest, waiting, False, now))
            return
        if waiting:
            self.waiting.clear()
        self.progress.update((want, passed, longest, 0, True, now))
        yield Row(submission_id=key[0], status=result[0], time_used=result[1], score=result[2], message=result[3], failed_case=result[4])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.progress.get()
        if known is not None:
            due = known[5] + (self.keep_closed_ms if known[4] else self.keep_idle_ms)
            if due <= timerValues.getCurrentProcessingTimeInMs():
                self.progress.clear()
                self.waiting.clear()
            else:
                self.handle.registerTimer(due)
        return iter([])

    def close(self) -> None:
        pass


def _packed(rows: pa.Table, codec: str | None = "zstd") -> bytes | None:
    if not rows.num_rows:
        return None
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes | None, schema: pa.Schema) -> pa.Table:
    return schema.empty_table() if data is None else pa.ipc.open_stream(bytes(data)).read_all()


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in names]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``bucket`` in front as one row per bucket with a table of them: the state's runner takes rows one by one."""
    def send(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        bucket = rows["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[order], return_index=True)
        rows = rows.select(ARRIVED.names).cast(ARRIVED).take(order).combine_chunks()
        tables = [_packed(rows.slice(i, j - i), None) for i, j in zip(starts, [*starts[1:], len(order)])]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(tables, pa.binary())], ["bucket", "rows"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
            if sum(x.num_rows for x in held) >= SENT_ROWS or sum(x.nbytes for x in held) >= SENT_BYTES:
                yield send(held)
                held = []
    if held:
        yield send(held)


class BulkEarlyFinish(StatefulProcessor):
    """All submissions of a bucket at once; the rules are those of ``EarlyFinish``."""

    def __init__(self, keep_closed_ms: int, keep_idle_ms: int):
        self.keep_closed_ms, self.keep_idle_ms = keep_closed_ms, keep_idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", BUCKET)

    def _known(self) -> tuple[int | None, pa.Table, pa.Table, pa.Table]:
        alarm, *tables = self.state.get() or (None, None, None, None)
        return alarm, *(_unpacked(t, s) for t, s in zip(tables, (CLOSED, OPEN, WAITING)))

    def _keep(self, alarm: int | None, closed: pa.Table, opened: pa.Table, waiting: pa.Table) -> None:
        """Write the state, with the timer at the time when the first submission is due."""
        due = min([int(t["touched"].to_numpy().min()) + keep for t, keep in ((closed, self.keep_closed_ms), (opened, self.keep_idle_ms))
                   if t.num_rows], default=None)
        if due is None:
            self.state.clear()
            return
        if alarm is None or due < alarm:
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            self.handle.registerTimer(due)
            alarm = due
        self.state.update((alarm, _packed(closed), _packed(opened), _packed(waiting)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        alarm, closed, opened, waiting = self._known()
        new = pa.concat_tables(_unpacked(t, ARRIVED) for frame in rows for t in frame["rows"])
        new = new.filter(pa.array(~np.isin(*_numbers(new, "submission_id"), *_numbers(closed, "submission_id"))))
        if not new.num_rows:
            return
        ids, at = np.unique(*_numbers(new, "submission_id"), return_inverse=True)
        n, total = len(ids), np.zeros(len(ids), np.int64)
        total[at] = new["total"].to_numpy()  # the last row's holds
        want, passed, longest = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        again = np.isin(*_numbers(opened, "submission_id"), ids)
        known = opened.filter(pa.array(again))
        place = np.searchsorted(ids, *_numbers(known, "submission_id"))
        want[place], passed[place], longest[place] = _numbers(known, "next", "passed", "longest")
        named = np.isin(*_numbers(waiting, "submission_id"), ids)
        cases = pa.concat_tables([waiting.filter(pa.array(named)), new.select(WAITING.names)])

        sub, ordinal = _numbers(cases, "submission_id", "ordinal")
        owner = np.searchsorted(ids, sub)
        order = np.lexsort((ordinal, owner))  # stable: of equal cases the last one counts
        owner, ordinal = owner[order], ordinal[order]
        last = np.append((owner[1:] != owner[:-1]) | (ordinal[1:] != ordinal[:-1]), True) & (ordinal >= want[owner])
        owner, ordinal, cases = owner[last], ordinal[last], cases.take(order[last])
        run = (ordinal - want[owner] == np.arange(len(owner)) - np.searchsorted(owner, owner)) & (ordinal <= total[owner])
        expected = cases["has_expected"].to_numpy()
        failing = run & expected & pc.not_equal(cases["status"], K.ACCEPTED).fill_null(True).to_numpy()
        never = np.iinfo(np.int64).max
        first = np.full(n, never)
        np.minimum.at(first, owner[failing], ordinal[failing])
        good = run & expected & (ordinal < first[owner])
        passed += np.bincount(owner[good], minlength=n)
        np.maximum.at(longest, owner[good], cases["time_used"].fill_null(0).to_numpy()[good])
        want += np.bincount(owner[run], minlength=n)
        failed = first != never
        done = ~failed & (want > total)
        still = ~failed & ~done

        touched = np.full(n, now, np.int64)
        self._keep(alarm, pa.concat_tables([closed, pa.table([ids[~still], touched[~still]], schema=CLOSED)]),
                   pa.concat_tables([opened.filter(pa.array(~again)),
                                     pa.table([c[still] for c in (ids, want, passed, longest, touched)], schema=OPEN)]),
                   pa.concat_tables([waiting.filter(pa.array(~named)), cases.filter(pa.array(~run & still[owner]))]))
        if still.all():
            return
        cause = failing & (ordinal == first[owner])
        who, why, met = owner[cause], cases.filter(pa.array(cause)), int(done.sum())
        columns = {"submission_id": (ids[who], ids[done]), "status": (why["status"], [K.ACCEPTED] * met),
                   "time_used": (why["time_used"], longest[done]), "score": (passed[who] * 100 // total[who], [100] * met),
                   "message": (why["message"], [K.MSG_PASSED % x for x in zip(passed[done].tolist(), total[done].tolist())]),
                   "failed_case": (ordinal[cause], [0] * met)}
        types = {c: pa.string() if c in ("status", "message") else pa.int64() for c in columns}
        parts = [pa.table({c: (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else pa.array(v, types[c])) for c, v in zip(columns, side)})
                 for side in zip(*columns.values())]
        out = pa.concat_tables(parts).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        yield out if key[0] >= 0 else out.assign(submission_id=pd.array([None] * len(out), "Int64"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        _, closed, opened, waiting = self._known()
        closed, opened = (t.filter(pa.array(t["touched"].to_numpy() + keep > now))
                          for t, keep in ((closed, self.keep_closed_ms), (opened, self.keep_idle_ms)))
        self._keep(None, closed, opened, waiting.filter(pa.array(np.isin(*_numbers(waiting, "submission_id"), *_numbers(opened, "submission_id")))))
        return iter([])

    def close(self) -> None:
        pass


def stream_early_finish(cases: DataFrame, keep_closed_ms: int = 24 * HOUR_MS, keep_idle_ms: int = 7 * 24 * HOUR_MS,
                        buckets: int | None = BUCKETS) -> DataFrame:
    """``cases`` (streaming): submission_id, ordinal (1..total within the submission), total,
    has_expected, status, time_used, message. Append output, one row per submission, emitted once.

    A closed submission ignores rows for ``keep_closed_ms`` after it closed; one whose
    cases never come in is dropped ``keep_idle_ms`` after its last contact. State lies in RocksDB, for as many
    ``buckets`` of submissions; without buckets per submission and waiting case, for single submissions
    whose waiting cases are too many for one value. A running stream's buckets must not be changed."""
    cases.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    if buckets is None:
        return cases.groupBy("submission_id").transformWithState(
            EarlyFinish(keep_closed_ms, keep_idle_ms), OUT, "Append", "ProcessingTime")
    sid = F.col("submission_id")
    due = {c: F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} of a case is null")).cast("long")) for c in ("ordinal", "total")}
    dealt = cases.select(
        F.when(sid.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(sid), F.lit(buckets))).cast("long").alias("bucket"),
        F.coalesce(sid, F.lit(0)).cast("long").alias("submission_id"), *[c.alias(n) for n, c in due.items()],
        F.coalesce("has_expected", F.lit(False)).alias("has_expected"), "status", F.col("time_used").cast("long").alias("time_used"), "message")
    return (dealt.mapInArrow(_by_bucket, "bucket long, rows binary").groupBy("bucket")
            .transformWithStateInPandas(BulkEarlyFinish(keep_closed_ms, keep_idle_ms), OUT, "Append", "ProcessingTime"))
