"""Class-based bigram language model with exchange clustering (operator 6)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import cogrouped, crc_mod, cut, discard, map_arrow, one_row, release, table, text_batches, tree_merge

#: Word classes; class 0 is the end token's and the last one that of rare and unknown words.
CLASSES = 32
#: Words seen less often stay in the rare class, where they share their context's probability.
MIN_COUNT = 4
SWEEPS = 2
#: Tokens in a block of documents; a block's dictionary is what a task looks words up in.
BLOCK_TOKENS = 2_000_000
#: Rows per Arrow batch of the small rows of dictionaries and profiles.
ENTRY_BATCH_ROWS = 10_000
DISCOUNT = 0.75
#: Pseudo-transitions that the classes' shares lend to a class.
ALPHA = 5.0
#: No word holds white space, so this stands for the end of a text.
END = "\n"
#: A word's neighbour counts in a block as the places that are not zero, most often a few of all.
COUNT = np.dtype([("place", "u1"), ("n", "<u4")])
#: The same in fewer bytes, as a sweep's profiles hold them: a count over 255, which few words have, takes several records of one place.
SMALL_COUNT = np.dtype([("place", "u1"), ("n", "u1")])


class _Ids(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def token_blocks(docs: DataFrame) -> DataFrame:
    """Documents (id, held, t) as blocks of about ``BLOCK_TOKENS`` tokens with a dictionary each.

    lids: 32-bit places in ``words`` of the tokens of the block's documents one
    after another, each document closed by the end token (place 0)."""
    text_batches(docs.sparkSession)
    schema = ("block long, ids array<long>, held array<boolean>, sizes array<int>, lids binary, "
              "words array<string>, counts array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def fresh():
            places = _Ids()
            places[END.encode()]
            return places, [], [], []

        def emit(places, ids, held, tokens):
            lids = np.concatenate(tokens)
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            known = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(lids[known], minlength=len(places))
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 24 | number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())),
                 pa.array([zstandard.compress(lids.astype("<u4").tobytes())], pa.binary()),
                 pa.array([[w.decode() for w in places]], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
                ["block", "ids", "held", "sizes", "lids", "words", "counts"])

        places, ids, held, tokens = fresh()
        n = 0
        for b in batches:
            for i, h, t in zip(*(c.to_pylist() for c in b.columns)):
                words = (t or "").encode().lower().split()
                own = np.zeros(len(words) + 1, np.int64)
                own[:-1] = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                ids.append(i)
                held.append(h)
                tokens.append(own)
                n += len(own)
                if n >= BLOCK_TOKENS:
                    yield emit(places, ids, held, tokens)
                    number, n = number + 1, 0
                    places, ids, held, tokens = fresh()
        if ids:
            yield emit(places, ids, held, tokens)

    return docs.mapInArrow(run, schema)


def _matrix(rows: DataFrame, classes: int) -> np.ndarray:
    """Sum of the blocks' class-transition counts (z binary), classes x classes."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for b in batches:
            for z in b.column(0):
                total += np.frombuffer(zstandard.decompress(z.as_py()), np.int64)
        yield one_row(zstandard.compress(total.tobytes()))

    z = tree_merge(rows.mapInArrow(merge, "z binary"), merge)
    total = np.frombuffer(zstandard.decompress(z), np.int64) if z else np.zeros(classes * classes, np.int64)
    return total.reshape(classes, classes)


def _block_classes(row, entries: pd.DataFrame, rare: int):
    """Tokens of a block, their classes, the class before each, and which ones are training tokens."""
    lids = np.frombuffer(zstandard.decompress(row.lids), "<u4").astype(np.int64)
    sizes = np.asarray(row.sizes, np.int64)
    cls = np.full(int(lids.max()) + 1, rare, np.int64)
    cls[0] = 0
    cls[entries["lid"].to_numpy()] = entries["cls"].to_numpy()
    token = cls[lids]
    before = np.concatenate(([0], token[:-1]))  # a text begins after an end token, and every text ends with one
    train = np.repeat(~np.asarray(row.held, bool), sizes)
    return lids, sizes, token, before, train


def exchange_gain(matrix: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Gain in the class bigram log-likelihood of moving each word to each class, all other words kept.

    left[w, c] and right[w, c]: how often w follows and precedes class c; own: its
    class. Words that follow themselves count as if their neighbour stayed."""
    phi = lambda x: x * np.log(np.maximum(x, 1e-12))
    m = matrix.astype(float)
    n = left.sum(axis=1)
    rows, cols = m.sum(axis=1), m.sum(axis=0)
    into = np.zeros(left.shape)
    for counts, table in ((left, m), (right, m.T)):                            # c -> B, B -> c
        # a word's counts are zero for most classes, and those change nothing
        word, c = np.nonzero(counts)
        if len(word):
            change = phi(table[c] + counts[word, c][:, None]) - phi(table)[c]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            into[word[first]] += np.add.reduceat(change, first)
    into -= phi(rows[None] + n[:, None]) - phi(rows)[None] + phi(cols[None] + n[:, None]) - phi(cols)[None]
    a_col, a_row = m[:, own].T, m[own]
    out = (phi(np.maximum(a_col - left, 0)) - phi(a_col)).sum(axis=1) + (phi(np.maximum(a_row - right, 0)) - phi(a_row)).sum(axis=1)
    out -= (phi(np.maximum(rows[own] - n, 0)) - phi(rows[own]) + phi(np.maximum(cols[own] - n, 0)) - phi(cols[own]))
    gain = into + out[:, None]
    gain[np.arange(len(own)), own] = 0
    return gain


def sparse_rows(counts: np.ndarray, record: np.dtype = COUNT) -> list[bytes]:
    """Each row of a matrix of counts (at most 256 columns) as records, which add up to the row."""
    row, place = np.nonzero(counts)
    n, most = counts[row, place], np.iinfo(record["n"]).max
    pieces = -(-n // most)
    row = np.repeat(row, pieces)
    out = np.empty(len(row), record)
    out["place"], out["n"] = np.repeat(place, pieces), most
    out["n"][np.cumsum(pieces) - 1] = n - most * (pieces - 1)
    data = out.tobytes()
    ends = np.cumsum(np.bincount(row, minlength=len(counts))) * record.itemsize
    return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def add_sparse(total: np.ndarray, at: np.ndarray, rows: list[bytes], record: np.dtype = COUNT) -> None:
    """Add the counts of ``rows`` to the rows ``at`` of ``total``."""
    width = np.fromiter(map(len, rows), np.int64, len(rows)) // record.itemsize
    _add_records(total, at, width, np.frombuffer(b"".join(rows), record))


def _add_records(total: np.ndarray, at: np.ndarray, width: np.ndarray, counts: np.ndarray) -> None:
    np.add.at(total.reshape(-1), np.repeat(at, width) * total.shape[1] + counts["place"], counts["n"].astype(total.dtype))


def _records(column: pa.Array, record: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """How many records each value of a binary column has, and all of them."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return np.diff(ends) // record.itemsize, data.view(record)


def exchange_sweep(blocks: DataFrame, entries: DataFrame, classes: int, sweep: int) -> DataFrame:
    """One sweep of the exchange algorithm: ``entries`` with every clustered word in its best class.

    ``entries`` (block, lid, wid, cls) are the clustered words of each block by number. The
    words' neighbour counts are summed by word, and all words move against the same
    class counts. Each count carries its block along, so that the new class goes
    back there without another join. A word's count c is the sum of the counts before it: it does not travel."""
    rare = classes - 1
    schema = "wid long, cls int, at long, lid int, profile binary"
    width = 2 * classes

    def profile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["wid", "cls", "at", "lid", "profile"]
        if not len(left):
            return pd.DataFrame({n: [] for n in names})
        row = next(left.itertuples())
        lids, _, token, before, train = _block_classes(row, right, rare)
        after = np.concatenate((token[1:], [0]))
        own = right["lid"].to_numpy()
        place = np.full(int(lids.max()) + 1, -1)  # row of a clustered word among the block's
        place[own] = np.arange(len(own))
        ok = train & (place[lids] >= 0)
        at = place[lids[ok]] * width
        counts = np.bincount(at + before[ok], minlength=len(own) * width)
        counts += np.bincount(at + classes + after[ok], minlength=len(own) * width)
        matrix = np.bincount(before[train] * classes + token[train], minlength=classes * classes)
        # the block's matrix goes under number -1, which no word has
        with_first = lambda first, col: np.concatenate(([first], right[col].to_numpy()))
        return pd.DataFrame({"wid": with_first(-1, "wid"), "cls": with_first(0, "cls"), "at": row.block,
                             "lid": with_first(0, "lid"), "profile": [
            zstandard.compress(matrix.astype(np.int64).tobytes()), *sparse_rows(counts.reshape(-1, width), SMALL_COUNT)]})

    text_batches(blocks.sparkSession, ENTRY_BATCH_ROWS)
    rows = cut(cogrouped(blocks.select("block", "held", "sizes", "lids"), entries.select("block", "lid", "wid", "cls"),
                         "block", profile, schema), "lm-profiles")
    release(blocks.sparkSession)
    matrix = _matrix(rows.where("wid < 0").select(F.col("profile").alias("z")), classes)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, total, cls = _Ids(), np.zeros((1024, width), np.int64), np.zeros(1024, np.int64)
        held = []
        for b in batches:
            code, words = pd.factorize(b.column(0).to_numpy())
            at = np.fromiter(map(places.__getitem__, words.tolist()), np.int64, len(words))[code]
            while len(places) > len(total):
                total, cls = np.concatenate((total, np.zeros_like(total))), np.concatenate((cls, np.zeros_like(cls)))
            _add_records(total, at, *_records(b.column(4), SMALL_COUNT))
            cls[at] = b.column(1).to_numpy()
            held.append((at.astype(np.int32), b.column(2), b.column(3), b.column(0)))
        best = cls.copy()
        for i in range(0, len(places), 256):
            part = slice(i, min(i + 256, len(places)))
            gain = exchange_gain(matrix, total[part, :classes], total[part, classes:], cls[part])
            gain[:, [0, rare]] = -np.inf
            to = gain.argmax(axis=1)
            better = gain[np.arange(len(to)), to] > 1e-9
            best[part] = np.where(better, to, cls[part])
        c = total[:, :classes].sum(axis=1)
        for at, *own in held:
            yield pa.RecordBatch.from_arrays([*own, pa.array(c[at]), pa.array(best[at].astype(np.int32))],
                                             ["block", "lid", "wid", "c", "cls"])

    moved = rows.where("wid >= 0").repartition("wid").mapInArrow(summed, "block long, lid int, wid long, c long, cls int")
    moved = cut(moved, f"lm-classes-{sweep}")
    discard(rows)
    return moved


def class_lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES,
                    min_count: int = MIN_COUNT, sweeps: int = SWEEPS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are parted at 0x20 and 0x09-0x0D with A-Z in lower case; one end token
    closes each text. Training rows are those whose crc32(id as text) mod 7 is not 2.
    score is the log10 probability of the text under P(class | class before) *
    P(word | class): transitions are smoothed by the classes' shares; the rare class
    gives up an absolute discount to one unknown word. No step needs the vocabulary
    in one place: texts become blocks with their own dictionaries, and dictionary
    entries meet the words' counts and classes by joins. Defined cases: null text is
    empty (the end token alone); repeated rows are counted and scored each; a null
    id counts as empty text in the split and stays null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rare = classes - 1
    id_ = F.col(f"`{id_col}`")
    rows = docs.select(id_.cast("long").alias("id"), (crc_mod(id_, 7) == 2).alias("held"), F.col(f"`{text_col}`").cast("string").alias("t"))
    blocks = cut(token_blocks(rows), "lm-blocks")
    entries = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("lid", "e")).select(
        "block", "lid", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    # From the join with the vocabulary on a word goes by its number there.
    vocabulary = cut(entries.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")
                     .withColumn("wid", F.monotonically_increasing_id()), "lm-vocabulary")
    release(spark)
    is_clustered = (F.col("c") >= min_count) & (F.col("word") != END)

    # The most frequent words begin a class each, the others in one by hash.
    seeds = [r["word"] for r in vocabulary.where(is_clustered).orderBy(F.desc("c"), "word").limit(classes - 2).collect()]
    start = F.pmod(F.xxhash64("word"), F.lit(classes - 2)) + 1
    for i, w in enumerate(seeds):
        start = F.when(F.col("word") == w, F.lit(i + 1)).otherwise(start)
    start = F.when(F.col("word") == END, F.lit(0)).when(~is_clustered, F.lit(rare)).otherwise(start)
    known = cut(entries.select("block", "lid", "word").join(vocabulary.select("word", "wid", "c", start.cast("int").alias("cls")), "word")
                .select("block", "lid", "wid", "c", "cls"), "lm-entries")
    others = vocabulary.where(~is_clustered).groupBy(F.when(F.col("word") == END, F.lit(0)).otherwise(F.lit(rare)).alias("cls")).agg(
        F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    discard(vocabulary)
    release(spark)
    fixed = F.col("cls").isin(0, rare)
    placed = known.where(~fixed)
    for sweep in range(sweeps):
        last, placed = placed, exchange_sweep(blocks, placed, classes, sweep)
        if sweep:
            discard(last)
        release(spark)

    words = placed.groupBy("wid").agg(F.first("c").alias("c"), F.first("cls").alias("cls"))
    by_class = {r["cls"]: (r["n"], r["v"]) for r in
                [*others, *words.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()]}
    tokens, types = sum(n for n, _ in by_class.values()), sum(v for _, v in by_class.values())
    mass = np.array([by_class.get(k, (0, 0))[0] for k in range(classes)], float)
    rare_types = by_class.get(rare, (0, 0))[1]

    def emission(c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """P(word | class): shares, but in the rare class a discount goes to the unknown word (c = 0)."""
        in_rare = np.where(c > 0, c - DISCOUNT, DISCOUNT * rare_types + 1) / (mass[rare] + 1)
        return np.where(cls == rare, in_rare, c / np.maximum(mass[cls], 1))

    doc_schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, emit_sum double, "
                  "moves binary, z binary")

    def look_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_sum", "emit_sum", "moves", "z"]
        if not len(left):
            return pd.DataFrame({n: [] for n in names})
        row = next(left.itertuples())
        lids, sizes, token, before, train = _block_classes(row, right, rare)
        c = np.zeros(int(lids.max()) + 1)
        c[right["lid"].to_numpy()] = right["c"].to_numpy()
        seen = c[lids]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        # The end token is known to the model even if no training text was seen.
        emit = np.where(lids == 0, 0.0, np.log10(emission(seen, token)))
        per = lambda v: np.bincount(doc, v, minlength=len(sizes))
        move = before * classes + token
        key, n = np.unique(doc * (classes * classes) + move, return_counts=True)
        ends = np.searchsorted(key, np.arange(1, len(sizes) + 1) * (classes * classes))
        starts = np.concatenate(([0], ends[:-1]))
        pairs = np.stack([key % (classes * classes), n], axis=1).astype("<i4")
        matrix = np.bincount(move[train], minlength=classes * classes).astype(np.int64)
        out = pd.DataFrame({"doc_id": pd.array(list(row.ids), dtype="Int64"), "held_out": list(row.held), "n_tokens": sizes,
                            "n_known": per(seen > 0).astype(np.int64), "base_sum": per(np.log10(seen + 1)), "emit_sum": per(emit),
                            "moves": [pairs[a:b].tobytes() for a, b in zip(starts, ends)], "z": None})
        total = pd.DataFrame({n: [None] for n in names})
        total["z"] = [zstandard.compress(matrix.tobytes())]
        return pd.concat([out, total.astype({"doc_id": "Int64"})], ignore_index=True)

    columns = ("block", "lid", "c", "cls")
    text_batches(spark, ENTRY_BATCH_ROWS)
    facts = known.where(fixed).select(*columns).union(placed.select(*columns))
    parts = cut(cogrouped(blocks.select("block", "ids", "held", "sizes", "lids"), facts, "block", look_up, doc_schema), "lm-documents")
    for replaced in (known, placed, blocks) if sweeps else (known, blocks):
        discard(replaced)
    release(spark)
    matrix = _matrix(parts.where("z is not null").select("z"), classes).astype(float)
    share = (matrix.sum(axis=0) + 1) / (matrix.sum() + classes)
    log_move = np.log10((matrix + ALPHA * share) / (matrix.sum(axis=1, keepdims=True) + ALPHA)).reshape(-1)

    def moved(b: pa.RecordBatch) -> pa.RecordBatch:
        sums = []
        for m in b.column(0).to_pylist():
            pairs = np.frombuffer(m, "<i4").reshape(-1, 2)
            sums.append(float((log_move[pairs[:, 0]] * pairs[:, 1]).sum()))
        return pa.RecordBatch.from_arrays([pa.array(sums, pa.float64()), *b.columns[1:]], ["m", *b.schema.names[1:]])

    per_doc = parts.where("z is null").select("moves", "doc_id", "held_out", "n_tokens", "n_known", "base_sum", "emit_sum")
    done = map_arrow(per_doc, moved, "m double, doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, emit_sum double")
    floor = math.log10(tokens + types + 1)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                       (F.col("base_sum") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
                       (F.col("m") + F.col("emit_sum")).alias("score"))


def op6_class_lm(spark, sf_dir: str) -> DataFrame:
    return class_lm_scores(table(spark, sf_dir, "documents"))
