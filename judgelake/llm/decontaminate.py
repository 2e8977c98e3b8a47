"""Benchmark decontamination by template windows (operator 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import cut, hash_filter, in_filter, row_key, table, text_batches

#: Canonical tokens in a window, and how many of them must be plain words.
WINDOW = 8
MIN_LITERALS = 4
#: Share of an item's tokens that consistent windows must cover.
MIN_COVERAGE = 0.5
#: Bits of the filter over the benchmark's windows, sent to every task.
FILTER_BITS = 26

LITERAL, NUMBER, NAME, UNIT = range(4)

#: Spelled numbers.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
                         "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
                         "hundred thousand million billion half".split())
#: Units of measure and money.
UNIT_WORDS = frozenset("kg mg km cm mm mph kmh gram grams kilogram kilograms metre metres meter meters kilometre "
                       "kilometres kilometer kilometers mile miles inch inches foot feet yard yards litre litres liter "
                       "liters gallon gallons ounce ounces pound pounds dollar dollars cent cents euro euros percent "
                       "second seconds minute minutes hour hours day days week weeks month months year years".split())

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_STOP = re.compile(r"[.!?:;][\"'”’»)\]]*$")


def _code(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


#: What stands for a placeholder in a window's hash.
_TYPE_CODES = np.array([0, _code("\x00number"), _code("\x00name"), _code("\x00unit")], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """White-space word -> its row in the tables of literal code, value code, type before
    context, capital, and whether it ends a sentence.

    A word of punctuation alone has type -1: it is no token, but may end a sentence."""

    def __init__(self):
        super().__init__()
        self._room(1 << 16)

    def _room(self, n: int) -> None:
        old = getattr(self, "literal", None)
        for name, kind in (("literal", np.uint64), ("value", np.uint64), ("kind", np.int8), ("capital", bool), ("stop", bool)):
            new = np.zeros(n, kind)
            if old is not None:
                new[:len(old)] = getattr(self, name)
            setattr(self, name, new)

    def begin(self) -> None:
        """Before a batch: forget all words if there are many."""
        if len(self) > 400_000:
            self.clear()

    def __missing__(self, w):
        n = len(self)
        if n == len(self.literal):
            self._room(2 * n)
        core = _EDGE.sub("", w)
        low = core.lower()
        if not core:
            kind = -1
        elif low.isalpha():
            kind = NUMBER if low in NUMBER_WORDS else UNIT if low in UNIT_WORDS else LITERAL
        else:
            kind = NUMBER if any(c.isdigit() for c in core) else LITERAL
        self.literal[n], self.value[n], self.kind[n] = _code(low), _code(core), kind
        self.capital[n], self.stop[n] = kind == LITERAL and core[0].isupper(), bool(_STOP.search(w))
        self[w] = n
        return n


class Templates:
    """Canonical token streams of a batch of texts and the hashes of their windows."""

    def __init__(self):
        self.words = _Words()

    def tokens(self, texts: list[str | None]):
        """(text index, position in the text, literal-or-placeholder code, value code, type) as arrays.

        A capitalised word is a name unless it begins the text or follows the end of a sentence."""
        split = [(t or "").split() for t in texts]
        at = np.repeat(np.arange(len(split)), [len(x) for x in split])
        words = self.words
        words.begin()
        row = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int64, len(at))
        literal, value, kind, capital, stop = (t[row] for t in (words.literal, words.value, words.kind, words.capital, words.stop))
        begins = np.ones(len(at), bool)
        begins[1:] = (at[1:] != at[:-1]) | stop[:-1]
        kind = np.where(capital & ~begins, NAME, kind)
        real = kind >= 0
        at, literal, value, kind = at[real], literal[real], value[real], kind[real]
        starts = np.searchsorted(at, np.arange(len(texts)))
        return at, np.arange(len(at)) - starts[at], np.where(kind > 0, _TYPE_CODES[kind], literal), value, kind

    @staticmethod
    def windows(at: np.ndarray, code: np.ndarray, kind: np.ndarray, size: int, literals: int):
        """(token index, hash) of every window of ``size`` tokens of one text with enough plain words."""
        n = len(code) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, np.uint64(size))
        for j in range(size):
            h = h * _BASE + (code[j:j + n] ^ (code[j:j + n] >> np.uint64(29)))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        plain = np.concatenate(([0], np.cumsum(kind == LITERAL)))
        ok = (at[:n] == at[size - 1:]) & (plain[size:] - plain[:n] >= literals)
        where = np.flatnonzero(ok)
        return where, h[where]


def _window_rows(texts: DataFrame, sizes: list[int], literals: dict[int, int], packed=None) -> DataFrame:
    """(id, pos, size, hash, total, types array<int>, values array<long>) for the windows of
    ``texts`` (id long, t); with a filter, only those that it lets through. ``total`` is
    the number of tokens of the text; types and values are those of the placeholders."""
    text_batches(texts.sparkSession)
    schema = "id long, pos int, size int, hash long, total int, slot array<int>, value array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for b in batches:
            ids = b.column(0).to_numpy()
            at, pos, code, value, kind = templates.tokens(b.column(1).to_pylist())
            total = np.bincount(at, minlength=len(ids))
            signed = value.view(np.int64)
            for size in sizes:
                where, h = templates.windows(at, code, kind, size, literals[size])
                if size < WINDOW and packed is None:  # a short item is one window of its own length
                    whole = total[at[where]] == size
                    where, h = where[whole], h[whole]
                if packed is not None:
                    hit = in_filter(packed.value, h)
                    where, h = where[hit], h[hit]
                if not len(where):
                    continue
                slots = [[int(j) for j in np.flatnonzero(kind[i:i + size] > 0)] for i in where.tolist()]
                values = [[int(signed[i + j]) for j in s] for i, s in zip(where.tolist(), slots)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at[where]]), pa.array(pos[where].astype(np.int32)),
                     pa.array(np.full(len(where), size, np.int32)), pa.array(h.view(np.int64)),
                     pa.array(total[at[where]].astype(np.int32)),
                     pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))],
                    ["id", "pos", "size", "hash", "total", "slot", "value"])

    return texts.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                 min_literals: int = MIN_LITERALS, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(key, doc_id, item_id, covered, total, changed_slots): documents that hold a benchmark item,
    verbatim or with other numbers, names and units.

    Both sides become streams of lower-case words with typed placeholders for
    numbers, names (capitals inside a sentence) and units. Windows of ``window``
    tokens with ``min_literals`` plain words are joined by hash; a fixed-size filter
    of the benchmark's windows keeps all others of the documents at home. Windows
    that lie on one alignment of a document and an item must agree: a slot value
    of the item stands for one value of the document throughout. Items are reported
    when consistent windows cover ``min_coverage`` of their tokens. An item shorter
    than a window is one window of its own length, with at most two placeholders and three plain words.
    Defined cases: null texts and items are empty and match nothing; rows of a null
    id are matched and reported under null; repeated rows are reported once; items
    with equal texts are each reported; empty tables give no rows.
    """
    sizes = list(range(3, window + 1))
    literals = {s: min_literals if s == window else max(3, s - 2) for s in sizes}
    # Distinct texts stand for their items: equal items need one set of windows.
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"),
                             F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("t"))
    items = items.withColumn("id", F.xxhash64("t"))
    marks = cut(_window_rows(items.select("id", "t").distinct(), sizes, literals), "bench-windows")
    used = sorted(r["size"] for r in marks.select("size").distinct().collect())
    packed = docs.sparkSession.sparkContext.broadcast(hash_filter(marks.select("hash"), FILTER_BITS))
    rows = docs.select(row_key(id_col, text_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    found = _window_rows(rows, used, literals, packed)
    d = found.select(F.col("id").alias("key"), F.col("pos").alias("dpos"), "hash", "size", F.col("value").alias("dvalue"))
    m = marks.select(F.col("id").alias("mark"), "pos", "total", "hash", "size", "slot", "value")
    hits = cut(d.join(m, ["hash", "size"]).select("key", "mark", (F.col("dpos") - F.col("pos")).alias("diag"), "pos", "size",
                                                  "total", "slot", "value", "dvalue").distinct(), "bench-hits")
    line = ["key", "mark", "diag"]
    slots = hits.select(*line, F.explode(F.arrays_zip("value", "dvalue")).alias("s")).select(*line, "s.value", "s.dvalue").distinct()
    clash = (slots.groupBy(*line, "value").agg(F.count("*").alias("n"), F.max((F.col("value") != F.col("dvalue")).cast("int")).alias("other"))
             .groupBy(*line).agg(F.max("n").alias("most"), F.sum("other").alias("changed")))
    good = hits.join(clash, line, "left").where("most is null or most = 1")
    at = good.select("key", "mark", "total", F.coalesce("changed", F.lit(0)).alias("changed"),
                     F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("size") - 1)).alias("p"))
    spans = (at.groupBy("key", "mark", "total", "p").agg(F.max("changed").alias("changed"))
             .groupBy("key", "mark", "total").agg(F.count("*").alias("covered"), F.max("changed").alias("changed_slots"))
             .where(F.col("covered") >= F.col("total") * min_coverage))
    ids = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").alias("doc_id")).distinct()
    names = items.select(F.col("id").alias("mark"), "item_id").distinct()
    return (spans.join(ids, "key").join(names, "mark")
            .select("key", "doc_id", "item_id", "covered", "total", "changed_slots"))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go; the rest keep their columns."""
    bad = cut(contaminated(docs, table(spark, sf_dir, "benchmark")).select("key").distinct(), "bench-bad")
    own = docs.withColumn("__key", row_key("doc_id", "text"))
    return own.join(bad, own["__key"] == bad["key"], "left_anti").select(docs.columns)
