"""Maximal periodic runs of words by block convolution (operator 12)."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import map_arrow, table

MIN_LENGTH = 12
#: 2**16 + 1, a prime: reductions are shifts, and 3 generates its units.
MOD, GENERATOR = 65_537, 3
#: Longest block. Beyond it the stride and the windows grow, the transform does not.
MAX_BLOCK = 64
#: Numbers of one array of a transform; a task's arrays stay this small at any text length.
CHUNK = 1 << 17


def _reduce(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same residue: 2**16 is -1."""
    return (x & 0xFFFF) - (x >> 16)


class Ntt:
    """Number-theoretic transform of the columns of an (n, m) array; n is a power of two up to 256.

    Sums are reduced once a product: numbers grow by at most one bit a level, far inside 64 bits.
    """

    def __init__(self, n: int):
        self.n, self.inverse_n = n, pow(n, -1, MOD)
        self.roots, h = {}, n // 2
        while h:
            w = pow(GENERATOR, (MOD - 1) // (2 * h), MOD)
            powers = [pow(w, k, MOD) for k in range(h)]
            self.roots[h] = [np.array(p, np.int64)[None, :, None] for p in (powers, [pow(x, -1, MOD) for x in powers])]
            h //= 2

    def forward(self, x: np.ndarray) -> np.ndarray:
        """In place; natural order in, bit-reversed order out."""
        h = self.n // 2
        while h:
            y = x.reshape(self.n // (2 * h), 2, h, -1)
            d = y[:, 0] - y[:, 1]
            y[:, 0] += y[:, 1]
            d *= self.roots[h][0]
            y[:, 1] = _reduce(d)
            h //= 2
        return x

    def backward(self, x: np.ndarray) -> np.ndarray:
        """In place; bit-reversed order in, natural order out, residues from 0."""
        h = 1
        while h < self.n:
            y = x.reshape(self.n // (2 * h), 2, h, -1)
            d = _reduce(y[:, 1] * self.roots[h][1])
            y[:, 1] = y[:, 0] - d
            y[:, 0] += d
            h *= 2
        return _reduce(x) * self.inverse_n % MOD


def scales(longest: int):
    """(stride, block, least period, greatest period) up to half the longest text."""
    stride = 2
    while True:
        lo, hi = (1, 6) if stride == 2 else (2 * stride - 1, 4 * stride - 2)
        if 2 * lo > longest:
            return
        yield stride, min(stride, MAX_BLOCK), lo, hi
        stride *= 2


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _seeds(ids: np.ndarray, bounds: np.ndarray, stride: int, block: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of blocks that occur again at a distance in lo..hi in their text.

    Word numbers are folded to so few bits that a block's sum of squared differences is
    under the modulus: the transform gives that sum itself, and it is zero where the folded
    words agree. No occurrence is missed; one of differing words is found by the extension.
    """
    bits = int(np.log2(np.sqrt((MOD - 1) / block)))
    n = 4 * block
    folded = np.zeros(len(ids) + n, np.int64)
    folded[:len(ids)] = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    squares = np.concatenate([[0], np.cumsum(folded * folded)])
    per_text = np.maximum(0, (np.diff(bounds) - block - lo) // stride + 1)
    place = np.repeat(bounds[:-1], per_text) + _ranges(per_text) * stride
    end = np.repeat(bounds[1:], per_text)
    step = n - block + 1  # offsets that one window answers
    windows = -(-(np.minimum(hi, end - block - place) - lo + 1) // step)
    at = np.repeat(np.arange(len(place)), windows)
    first = lo + _ranges(windows) * step  # the distance of a window's first offset
    ntt, found = Ntt(n), []
    width = max(1, CHUNK // n)
    rows, offsets = np.arange(n)[:, None], np.arange(step)[:, None]
    for k in range(0, len(at), width):
        p, d = place[at[k:k + width]], first[k:k + width]
        pattern = np.zeros((n, len(p)), np.int64)
        pattern[-np.arange(block)] = folded[p + np.arange(block)[:, None]]
        start = p + d
        window = folded[np.minimum(start + rows, len(folded) - 1)]
        product = _reduce(_reduce(ntt.forward(pattern))) * _reduce(_reduce(ntt.forward(window)))
        shared = ntt.backward(_reduce(_reduce(product)))[:step]
        begin = np.minimum(start + offsets, len(squares) - 1 - block)
        total = squares[p + block] - squares[p] + squares[begin + block] - squares[begin] - 2 * shared
        distance = d + offsets
        hit = (total % MOD == 0) & (distance <= hi) & (p + distance + block <= end[at[k:k + width]])
        o, c = np.nonzero(hit)
        found.append((p[c], distance[o, c]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class _Prefixes:
    """Prefix hashes modulo 2**64 of a word sequence, for the lengths of common extensions."""

    def __init__(self, ids: np.ndarray):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), 0xD1342543DE82EF95, np.uint64)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((x ^ (x >> np.uint64(31))) * self.power[:-1])])

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Are the n words from a those from b? a < b."""
        return (self.sums[a + n] - self.sums[a]) * self.power[b - a] == self.sums[b + n] - self.sums[b]

    def extend(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, left: bool) -> np.ndarray:
        """How many words after (or before) places a and b agree, up to ``most``."""
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = self.same(a - mid, b - mid, mid) if left else self.same(a, b, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo


def _stretch(words: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The stretch of period p around place ``at``, word by word."""
    bad = np.flatnonzero(words[:-p] != words[p:])
    k = np.searchsorted(bad, at)
    return (int(bad[k - 1]) + 1 if k else 0), (int(bad[k]) + p if k < len(bad) else len(words))


def find_runs(ids: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(text, start, length, period) rows of all runs of the texts ids[bounds[t]:bounds[t+1]].

    A run of period p is at least p words long before its last p. At the scale whose
    periods hold p its first words hold a whole aligned block, which occurs again p words on:
    the block's convolution with the windows after it finds that distance. Each
    place and distance is extended to both sides; what is long enough is a stretch of
    period p, and of equal stretches the least period counts. Seeds inside a run found
    already, at a multiple of its period, give that run again and are left out.
    """
    runs = np.zeros((0, 3), np.int64)  # begin, end, period over all texts
    prefixes = None
    lengths = np.diff(bounds)
    for stride, block, lo, hi in scales(int(lengths.max(initial=0))):
        place, p = _seeds(ids, bounds, stride, block, lo, hi)
        known = runs[(runs[:, 2] <= stride) & (runs[:, 1] - runs[:, 0] >= 2 * stride - 1)]
        if len(known) and len(place):
            # two runs of periods up to the stride share fewer words than that: the last to begin is the one
            known = known[np.argsort(known[:, 0], kind="stable")]
            k = np.searchsorted(known[:, 0], place, side="right") - 1
            inside = (k >= 0) & (p % known[k, 2] == 0) & (place + p <= known[k, 1])
            place, p = place[~inside], p[~inside]
        if not len(place):
            continue
        prefixes = prefixes or _Prefixes(ids)
        text = np.searchsorted(bounds, place, side="right") - 1
        begin = place - prefixes.extend(place, place + p, place - bounds[text], True)
        end = place + p + prefixes.extend(place, place + p, bounds[text + 1] - place - p, False)
        long = end - begin >= np.maximum(min_length, 2 * p)
        found = {}
        for t, b, e, q, at in np.stack([text, begin, end, p, place], 1)[long].tolist():
            if (b, e, q) not in found:
                ok = np.array_equal(ids[b:e - q], ids[b + q:e])
                if not ok:  # words of equal hashes: count them one by one
                    own = _stretch(ids[bounds[t]:bounds[t + 1]], at - int(bounds[t]), q)
                    own = (int(bounds[t]) + own[0], int(bounds[t]) + own[1])
                found[b, e, q] = (b, e) if ok else own
        fresh = {(b, e, q) for (_, _, q), (b, e) in found.items() if e - b >= max(min_length, 2 * q)}
        if fresh:
            runs = np.concatenate([runs, np.array(sorted(fresh), np.int64)])
            runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
            runs = runs[np.concatenate([[True], (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    text = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    return np.stack([text, runs[:, 0] - bounds[text], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(place, period) from where on the query's contract makes a text of n words periodic, or None."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  repeat: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period), collapsed string: the
    words that no run holds after its first period, joined by one blank.

    A run is a stretch of words with least period q that no neighbouring word extends, of
    ``min_length`` and 2q words at least. ``repeat`` may rewrite a text first: (a, p) makes each word i
    from a on the original word a + (i - a) % p. Each task streams its own rows; a batch's texts are
    transformed together in arrays of fixed size, and a text costs its length times the number of scales.
    Defined cases: null, empty and blank texts have no words and no runs; repeated rows and null ids
    count each; other columns are left out whatever their names; an empty table gives no rows.
    """
    if min_length < MIN_LENGTH:
        raise ValueError(f"runs are found from {MIN_LENGTH} words on")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [(t or b"").split() for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
        bounds = np.cumsum([0, *map(len, words)])
        ids = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        ids = ids.astype(np.int64)
        if repeat:
            for t, doc in enumerate(batch.column(0).to_pylist()):
                n = len(words[t])
                rule = repeat(doc, n)
                if rule:
                    a, p = rule
                    source = np.arange(n)
                    source[a:] = a + (source[a:] - a) % p
                    ids[bounds[t]:bounds[t + 1]] = ids[bounds[t]:bounds[t + 1]][source]
                    words[t] = [words[t][i] for i in source]
        found = find_runs(ids, bounds, min_length)
        depth = np.zeros(len(ids) + 1, np.int64)
        begin = bounds[found[:, 0]] + found[:, 1]
        np.add.at(depth, begin + found[:, 3], 1)
        np.add.at(depth, begin + found[:, 2], -1)
        keep = np.cumsum(depth) == 0
        has = set(found[:, 0].tolist())
        collapsed = [b" ".join([w for w, k in zip(ws, keep[bounds[t]:].tolist()) if k] if t in has else ws) for t, ws in
                     ((t, ws) for t, ws in enumerate(words))]
        counts = np.bincount(found[:, 0], minlength=len(words))
        structs = pa.StructArray.from_arrays([pa.array(found[:, k], pa.int64()) for k in (1, 2, 3)], ["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), structs)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(bounds), pa.int64()), runs, pc.cast(pa.array(collapsed, pa.binary()), pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])

    return map_arrow(src, run, schema)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), repeat=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("b"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("*", best.alias("_best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.a")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.b")).alias("period"), F.expr("_best.length * 1000 div -_best.b").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
