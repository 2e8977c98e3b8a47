"""Sequence packing as a cutting-stock problem (operator 4)."""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from judgelake.llm.common import cut, share, table, text_batches

CAPACITY = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k"
#: Pivots of the simplex method and the relative gap to a lower bound at which it stops before.
MAX_PIVOTS = 300
GAP = 1e-3
#: Words whose ids a task remembers.
REMEMBERED = 600_000
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The byte-level pattern never joins a word with the white space after it, so
    where white space is single blanks and line ends each word has its own ids:
    they are looked up, and unknown words are encoded together and parted again by
    their byte lengths. All other texts are encoded whole. ``path`` names the JSON
    vocabulary; its ranks lie beside it and give the same ids several times faster.
    """

    def __init__(self, path: str | None = None):
        path = path or public_tokenizers.path(f"{VOCABULARY}.json")
        self.json = path
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.widths[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.slow = None
        self.line_end = len(self._whole("\n"))

    def _whole(self, text: str) -> bytes:
        if SPECIAL in text:
            if self.slow is None:
                self.slow = Tokenizer.from_file(self.json)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """A word's ids include the blank before it; a word that begins with a line end stands alone."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        odd = [w for w in words if SPECIAL in w]
        plain = [w for w in words if SPECIAL not in w] if odd else words
        for w in odd:
            self.known[w] = self._whole(w if w[0] == "\n" else " " + w)
        chunks = [w if w[0] == "\n" else " " + w for w in plain]
        ids = np.array(self.fast.encode_ordinary("".join(chunks)), np.int64)
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)))
        at = np.searchsorted(np.cumsum(self.widths[ids]), ends, side="left") + 1
        data, start = ids.astype("<u4").tobytes(), 0
        for w, end in zip(plain, (at * 4).tolist()):
            self.known[w] = data[start:end]
            start = end

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        parts = []
        for t in texts:
            t = t or ""
            clean = len(t.split()) == t.count(" ") + t.count("\n") + 1
            parts.append(("\n" + t).replace("\n", " \n").split(" ")[1:] if clean else None)
        unknown = set(chain.from_iterable(p for p in parts if p)).difference(self.known)
        if len(self.known) + len(unknown) > REMEMBERED:
            self.known.clear()
            unknown = set(chain.from_iterable(p for p in parts if p))
        if unknown:
            self._learn(list(unknown))
        get = self.known.__getitem__
        return [self._whole(t or "") if p is None else b"".join(map(get, p))[self.line_end:] for t, p in zip(texts, parts)]


def document_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                    capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Documents as token ids with ``end_id`` last, cut at every ``capacity`` ids.

    part and rank: the task and the running number of the piece among its task's
    pieces of the same length; they hold once the result is written down."""
    text_batches(docs.sparkSession)
    schema = "part int, rank long, doc_id long, start long, length int, doc_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for i, ids in zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    k = min(capacity, n - s)
                    rows.append((int(seen[k]), i, s, k, n, ids[4 * s:4 * (s + k)]))
                    seen[k] += 1
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64()),
                 pa.array(cols[5], pa.binary())],
                ["part", "rank", "doc_id", "start", "length", "doc_tokens", "ids"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return src.mapInArrow(run, schema)


def greedy_patterns(lengths: list[int], demand: list[float], capacity: int,
                    whole: bool) -> list[tuple[dict[int, int], float, int]]:
    """Longest-first patterns over a histogram of lengths, each used until one of its lengths runs out:
    (pattern, uses, the length that ended).

    With ``whole`` the counts stay integers and only full patterns are kept; otherwise
    every unit of demand is covered and the patterns form a triangular basis."""
    left = dict(zip(lengths, demand))
    order = sorted(lengths)
    out = []
    while order:
        pattern, room, i = {}, capacity, len(order) - 1
        while i >= 0:
            size = order[i]
            k = min(room // size, int(left[size]) if whole else room // size)
            if k:
                pattern[size] = k
                room -= k * size
            i = min(i, bisect.bisect_right(order, room)) - 1
        if not pattern:
            break
        uses = min(left[s] // k if whole else left[s] / k for s, k in pattern.items())
        if whole and room:  # not full: its longest length cannot be served without waste
            del left[order.pop()]
            continue
        ended = min(pattern, key=lambda s: left[s] / pattern[s])
        out.append((pattern, uses, ended))
        for s, k in pattern.items():
            left[s] = max(0, left[s] - uses * k)
        gone = [s for s in pattern if left[s] < 1] if whole else [ended]
        for s in gone:
            order.remove(s)
            del left[s]
    return out


def best_pattern(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The pattern of the highest total price: an unbounded knapsack by dynamic programming over the room."""
    by_room = np.full(capacity + 1, -np.inf)
    by_room[lengths] = price
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        gain = best[room - 1::-1][:room] + by_room[1:room + 1]
        k = int(gain.argmax())
        if gain[k] > best[room - 1] + 1e-12:
            best[room], taken[room] = gain[k], k + 1
        else:
            best[room] = best[room - 1]
    pattern, room = {}, capacity
    while room > 0:
        if taken[room]:
            pattern[int(taken[room])] = pattern.get(int(taken[room]), 0) + 1
            room -= int(taken[room])
        else:
            room -= 1
    return float(best[capacity]), pattern


def cutting_stock(histogram: dict[int, int], capacity: int = CAPACITY, max_pivots: int = MAX_PIVOTS,
                  gap: float = GAP) -> list[tuple[dict[int, int], float]]:
    """The linear program of cutting stock by column generation: (pattern, how often) with fractions.

    Rows are the lengths of the histogram, so its size is bounded by ``capacity``.
    The simplex method starts from the longest-first patterns; each step prices a
    column by the knapsack and exchanges it into the basis, until the objective is
    within ``gap`` of a lower bound: the ids divided by the capacity, or the
    objective divided by the best price."""
    lengths = sorted(histogram)
    if not lengths:
        return []
    start = greedy_patterns(lengths, [float(histogram[s]) for s in lengths], capacity, whole=False)
    row = {s: i for i, s in enumerate(lengths)}
    m = len(lengths)
    basis = [p for p, _, _ in start]
    # The n-th pattern ends one length and later ones do without it, so the basis is
    # triangular in that order and its inverse follows row by row from few entries.
    holds: dict[int, list[tuple[int, int]]] = {}
    for j, p in enumerate(basis):
        for s, k in p.items():
            holds.setdefault(s, []).append((j, k))
    inverse = np.zeros((m, m))
    for j, (_, _, ended) in enumerate(start):
        inverse[j, row[ended]] = 1.0
        for i, k in holds[ended]:
            if i != j:
                inverse[j] -= k * inverse[i]
        inverse[j] /= basis[j][ended]
    x = (inverse * np.array([histogram[s] for s in lengths], float)).sum(axis=1)
    sizes = np.array(lengths)
    least = sum(s * n for s, n in histogram.items()) / capacity
    for _ in range(max_pivots):
        if x.sum() <= least * (1 + gap):
            break
        best, pattern = best_pattern(sizes, inverse.sum(axis=0), capacity)
        least = max(least, x.sum() / best)
        if best <= 1 + gap:
            break
        d = sum(k * inverse[:, row[s]] for s, k in pattern.items())
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        x = x - ratio[r] * d
        x[r] = ratio[r]
        inverse[r] /= d[r]
        others = np.flatnonzero(np.abs(d) > 1e-12)
        others = others[others != r]
        inverse[others] -= d[others, None] * inverse[r]
        basis[r] = pattern
    return [(p, max(0.0, float(v))) for p, v in zip(basis, x)]


@dataclass
class Plan:
    """Where the n-th piece of a length goes. Rows of ``slots`` for each length: first
    rank, copies of the length in a sequence, first sequence, offset in it."""

    slots: dict[int, np.ndarray]
    served: np.ndarray
    stream_at: np.ndarray
    stream_total: int
    sequences: int
    capacity: int

    def tail(self) -> list[tuple[int, int]]:
        """(start in the stream, length) of the last sequences: powers of two, largest first."""
        at = self.stream_total // self.capacity * self.capacity
        out, rest = [], self.stream_total - at
        while rest:
            size = 1 << (rest.bit_length() - 1)
            out.append((at, size))
            at, rest = at + size, rest - size
        return out

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the piece, length, sequence, offset) of its parts; more than one if it is cut."""
        if rank < self.served[length]:
            rows = self.slots[length]
            first, copies, base, offset = (int(v) for v in rows[np.searchsorted(rows[:, 0], rank, side="right") - 1])
            return [(0, length, base + (rank - first) // copies, offset + (rank - first) % copies * length)]
        at = int(self.stream_at[length]) + (rank - int(self.served[length])) * length
        full, out, done = self.stream_total // self.capacity, [], 0
        tail = self.tail()
        while done < length:
            here = at + done
            if here < full * self.capacity:
                n, start, size = here // self.capacity, here // self.capacity * self.capacity, self.capacity
            else:
                n, (start, size) = next((full + i, v) for i, v in enumerate(tail) if here < sum(v))
            take = min(length - done, start + size - here)
            out.append((done, take, self.sequences + n, here - start))
            done += take
        return out


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Round the linear program to whole sequences without padding, and lay the rest end to end.

    Fractions are rounded down; what is left over is matched by longest-first
    patterns. Only full patterns are used. The remaining pieces form one stream
    that is cut at every ``capacity`` ids, its tail at powers of two, so nothing is padded."""
    demand = {s: n for s, n in histogram.items() if s < capacity}
    chosen, left = [], dict(demand)
    for pattern, uses in cutting_stock(demand, capacity):
        uses = min(int(uses + 1e-6), *(left[s] // k for s, k in pattern.items()))
        if uses > 0 and sum(s * k for s, k in pattern.items()) == capacity:
            chosen.append((pattern, uses))
            for s, k in pattern.items():
                left[s] -= k * uses
    rest = {s: n for s, n in left.items() if n > 0}
    for pattern, uses, _ in greedy_patterns(sorted(rest), [rest[s] for s in sorted(rest)], capacity, whole=True):
        chosen.append((pattern, int(uses)))
    if histogram.get(capacity):
        chosen.append(({capacity: 1}, histogram[capacity]))
    slots: dict[int, list] = {}
    served, sequences = np.zeros(capacity + 1, np.int64), 0
    for pattern, uses in chosen:
        offset = 0
        for s, k in sorted(pattern.items(), reverse=True):
            slots.setdefault(s, []).append((served[s], k, sequences, offset))
            served[s] += k * uses
            offset += s * k
        sequences += uses
    over = np.array([histogram.get(s, 0) - served[s] for s in range(capacity + 1)])
    tokens = over * np.arange(capacity + 1)
    return Plan({s: np.array(v, np.int64) for s, v in slots.items()}, served, np.cumsum(tokens) - tokens,
                int(tokens.sum()), sequences, capacity)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids binary
    (little-endian unsigned 32-bit). Every sequence is filled without gaps; all but at most 11 are full, and
    those few have a power of two of ids.

    The driver sees a histogram of at most ``capacity`` lengths. Pieces are ranked
    within their length by their task's running number plus the counts of the tasks
    before it, so no group of pieces meets in one task. Defined cases: null text is
    empty and gives the end id alone; repeated rows are packed each; a null doc_id
    stays null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = cut(document_pieces(docs, id_col, text_col, path, capacity, end_id), "pieces")
    counts = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = share(spark, plan_sequences(histogram, capacity))
    before = counts.select("part", "length", (F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select(
        (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), "doc_id", "start", "length", "doc_tokens", "ids")
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan()
        for b in batches:
            rows = []
            for rank, doc, start, length, total, ids in zip(*(c.to_pylist() for c in b.columns)):
                for s, k, sequence, offset in p.place(length, rank):
                    rows.append((doc, start + s, k, total, sequence, offset, ids[4 * s:4 * (s + k)]))
            cols = list(zip(*rows))
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())],
                                                 ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return ranked.mapInArrow(run, schema)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of what is left, in their sequences."""
    return digest(pack(docs))
