"""SimHash near-duplicates with pigeonring candidate filtering (operator 8)."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import cut, map_arrow, table
from judgelake.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Shingle hashes tallied at once, so that a very long text needs little memory.
TALLY_ROWS = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 without words.

    ``bytes.lower`` and ``bytes.split`` change A-Z alone and part words at
    0x20 and 0x09-0x0D alone, which is the tokenisation wanted here.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:len(words) - k])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts, (ends[k - 1:] - 1).tolist())],
                      dtype=np.uint64)
    tally = np.zeros(64, np.int64)
    for i in range(0, len(hashes), TALLY_ROWS):
        part = hashes[i:i + TALLY_ROWS]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        tally += bits.sum(axis=0, dtype=np.int32)
    on = tally * 2 > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long): the fingerprint as a signed 64-bit number, one row per input row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return map_arrow(src, run, "doc_id long, fp long")


def ring_segments(max_bits: int) -> list[tuple[int, int]]:
    """(offset, width) of max_bits + 1 segments that cover the 64 bits."""
    m = max_bits + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in pairwise(edges)]


def _bits(col, offset: int, width: int):
    return F.shiftrightunsigned(col, offset).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else col


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) with a < b: every pair of distinct values of ``fps`` (fp long) at
    most ``max_bits`` bits apart, each pair once.

    Pigeonring: lay m = max_bits + 1 segments on a ring. If two values differ in
    at most max_bits bits, some start segment has, for every chain length l, at
    most floor(l * max_bits / m) differing bits in its first l segments. For l = 1
    that means an equal start segment. For l = 2 (one differing bit allowed when
    max_bits is 2 or more) one half of the next segment is equal too, so the
    pair meets under the key (start, segment, half, half's value) of about
    (64/m) * 1.5 bits. The longer chains are then checked on the joined pair, and
    the full distance last. A pair is emitted only under the first key that it
    satisfies, so no distinct is needed.
    """
    segs = ring_segments(max_bits)
    m = len(segs)

    def halves(i: int) -> list[tuple[int, int]]:
        o, w = segs[(i + 1) % m]
        # One differing bit in the next segment leaves one of its halves equal.
        return [(o, w // 2), (o + w // 2, w - w // 2)] if m > 1 and 2 * max_bits // m == 1 else [(0, 0)]

    keys = [(i, h) for i in range(m) for h in halves(i)]

    def key_value(col, i: int, h: tuple[int, int]):
        seg = _bits(col, *segs[i])
        return seg if h[1] == 0 else F.shiftleft(seg, h[1]).bitwiseOR(_bits(col, *h))

    def keyed(name: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(n).alias("n"), key_value(F.col("fp"), i, h).alias("v"))
                         for n, (i, h) in enumerate(keys)])
        return fps.select(F.col("fp").alias(name), F.explode(rows).alias("k")).select(name, "k.n", "k.v")

    x = F.col("a").bitwiseXOR(F.col("b"))

    def chain_ok(i: int):
        ok, total = F.lit(True), F.lit(0)
        for l in range(1, m + 1):
            total = total + F.bit_count(_bits(x, *segs[(i + l - 1) % m]))
            ok = ok & (total <= l * max_bits // m)
        return ok

    def meets(i: int, h: tuple[int, int]):
        return chain_ok(i) & (key_value(x, i, h) == 0)

    first = F.lit(-1)
    for n, (i, h) in reversed(list(enumerate(keys))):
        first = F.when(meets(i, h), F.lit(n)).otherwise(first)
    left, right = keyed("a"), keyed("b").withColumnRenamed("n", "n2").withColumnRenamed("v", "v2")
    on = (F.col("n") == F.col("n2")) & (F.col("v") == F.col("v2")) & (F.col("a") < F.col("b")) \
        & (F.bit_count(x) <= max_bits) & (first == F.col("n"))
    return left.join(right, on).select("a", "b")


def simhash_components(own: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``own`` (fp long and any others) with component, the smallest fingerprint in reach.

    Only distinct fingerprints are joined with each other."""
    comp = connected_components(fingerprint_links(own.select("fp").distinct(), max_bits))
    comp = comp.select(F.col("id").alias("fp"), "component")
    return own.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, fp long, component_id.

    Texts are grouped by equal fingerprints first; only distinct fingerprints
    are joined. component_id is the smallest doc_id whose fingerprint can be
    reached over links. Defined cases: a null or blank text has fingerprint 0 and
    is linked like any other; a repeated row is kept and linked with itself's
    group; a row with a null id keeps its fingerprint and takes the component of
    its group (null if nothing in it has an id); an empty table gives no rows.
    """
    own = cut(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-fp")
    grouped = simhash_components(own, max_bits)
    heads = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = grouped.select("fp", "component").distinct().join(heads, "component").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the row of the smallest doc_id stays.

    Repeated rows of that id are one group as well: the first by a hash of the row stays.
    Groups without any id keep one row likewise."""
    own = cut(docs.withColumn("__key", F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
              .withColumn("__n", F.monotonically_increasing_id()), "simhash-rows")
    keyed = own.select(F.col("__n").alias("n"), F.col("__key").alias("k"), F.col("doc_id").cast("long").alias("id"), "text")
    fps = fingerprints(keyed, "n", "text").withColumnRenamed("doc_id", "n").join(keyed.select("n", "k", "id"), "n")
    groups = simhash_components(cut(fps, "simhash-fp"))
    place = F.struct(F.col("id").isNull(), "id", "k", "n")
    first = groups.groupBy("component").agg(F.min(place).alias("first")).select(F.col("first.n").alias("__n"))
    return own.join(first, "__n", "left_semi").select(docs.columns)
