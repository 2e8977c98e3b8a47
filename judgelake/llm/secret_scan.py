"""Secret scan: fixed patterns plus a character convolutional network (operator 3)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import cut, map_arrow, one_row, share, table, tree_merge

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")

#: A candidate for the network: a run of key characters with a digit and a letter in it.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=@-])(?=[A-Za-z+/_.=@-]*[0-9])(?=[0-9+/_.=@-]*[A-Za-z])[A-Za-z0-9+/_.=@-]{12,}")
#: Any long run, among them plain words: the network's negative examples.
RUN = re.compile(r"[A-Za-z0-9+/_.=@()-]{12,}")

#: Rounds of training, and the examples that a task trains on by itself in one of them.
ROUNDS, SHARD_ROWS = 12, 4_000
#: Share of the calibration findings that must be found.
MIN_RECALL = 0.98
BEFORE, INSIDE, AFTER = 24, 48, 16
WIDTH = BEFORE + INSIDE + AFTER
CLASSES, KERNEL, FILTERS = 20, 5, 16


def _class_table() -> np.ndarray:
    """Byte -> character class: letters by case and hex range, digits, key punctuation, blanks, others; 0 is padding."""
    out = np.full(256, 19, np.uint8)
    for chars, c in (("abcdef", 1), ("ghijklmnopqrstuvwxyz", 2), ("ABCDEF", 3), ("GHIJKLMNOPQRSTUVWXYZ", 4),
                     ("01234567", 5), ("89", 6), ("+", 7), ("/", 8), ("_", 9), (".", 10), ("=", 11), ("-", 12), (":", 13),
                     ("\"'`", 14), (" \t", 15), ("\r\n", 16), ("@", 17), ("()[]{}<>", 18)):
        for x in chars:
            out[ord(x)] = c
    out[0] = 0
    return out


CLASS_OF = _class_table()


def context(text: str, start: int, end: int) -> bytes:
    """The candidate's first characters between its surroundings, one byte per character."""
    left = text[max(0, start - BEFORE):start].rjust(BEFORE, "\0")
    inside = text[start:min(end, start + INSIDE)].ljust(INSIDE, "\0")
    right = text[end:end + AFTER].ljust(AFTER, "\0")
    return (left + inside + right).encode("latin-1", "replace")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind that pass its length rule, by start, then kind as listed.

    A run of hex digits and an access key are maximal runs, so asking for their
    length inside the pattern finds the same spans."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX_RUN.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and further candidates that overlap none of them.

    Characters such as a final full stop belong to the prose and are left off."""
    base = base_spans(text)
    more = []
    for m in CANDIDATE.finditer(text):
        s, e = m.start(), m.start() + len(m[0].rstrip(".=-"))
        if e - s >= 12 and not any(s < b and a < e for a, b, _ in base):
            more.append((s, e, "model"))
    return base, more


def plain_runs(text: str) -> list[tuple[int, int]]:
    """Negative examples: all long runs of prose, addresses and numbers of a text without any base finding."""
    return [] if base_spans(text) else [m.span() for m in RUN.finditer(text)]


def encode(windows: list[bytes]) -> np.ndarray:
    return CLASS_OF[np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)] if windows else np.zeros((0, WIDTH), np.uint8)


@dataclass
class CharCNN:
    """Convolution over character classes, rectified, pooled by maximum before, inside and after the candidate, then logistic."""

    kernel: np.ndarray  # position in the kernel x class x filter
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    #: Pooled parts of the window, as positions of the convolution's result.
    PARTS = ((0, BEFORE), (BEFORE - 2, BEFORE + INSIDE - 2), (WIDTH - AFTER - 4, WIDTH - KERNEL + 1))

    @classmethod
    def fresh(cls, seed: int = 7) -> CharCNN:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (KERNEL, CLASSES, FILTERS)), np.zeros(FILTERS),
                   rng.normal(0, 0.1, FILTERS * len(cls.PARTS)), 0.0)

    def _forward(self, x: np.ndarray):
        n = WIDTH - KERNEL + 1
        z = self.bias + sum(self.kernel[j][x[:, j:j + n]] for j in range(KERNEL))
        pooled, where = [], []
        for a, b in self.PARTS:
            at = z[:, a:b].argmax(axis=1)
            where.append(at + a)
            pooled.append(np.take_along_axis(z[:, a:b], at[:, None], axis=1)[:, 0])
        pooled = np.concatenate(pooled, axis=1)
        h = np.maximum(pooled, 0)
        return (h * self.out).sum(axis=1) + self.out_bias, pooled, h, where

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i:i + 1024])[0] for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> CharCNN:
        """Adam on the log loss; classes weigh alike."""
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        adam = Adam.fresh(self)
        for _ in range(epochs):
            adam.epoch(x, y, weight, rng, batch, rate)
        self.kernel, self.bias, self.out, self.out_bias = *adam.params[:3], float(adam.params[3][0])
        return self


@dataclass
class Adam:
    """A network in training: its parameters, their two moments and the steps made."""

    params: list[np.ndarray]
    m: list[np.ndarray]
    v: list[np.ndarray]
    step: float

    #: Parts of one in the whole numbers that ``pack`` gives.
    PARTS = float(1 << 30)

    @classmethod
    def fresh(cls, net: CharCNN) -> Adam:
        params = [net.kernel.copy(), net.bias.copy(), net.out.copy(), np.array([net.out_bias])]
        return cls(params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0.0)

    def net(self) -> CharCNN:
        return CharCNN(*self.params[:3], float(self.params[3][0]))

    def epoch(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, batch: int = 64, rate: float = 0.01) -> None:
        """One pass over the rows, in an order of ``rng``."""
        params, m, v = self.params, self.m, self.v
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            rows = order[i:i + batch]
            xs, net = x[rows], self.net()
            score, pooled, h, where = net._forward(xs)
            g = (1 / (1 + np.exp(-score)) - y[rows]) * weight[rows] / len(rows)
            back = (g[:, None] * net.out) * (pooled > 0)
            grads = [np.zeros_like(net.kernel), back.reshape(len(rows), -1, FILTERS).sum(axis=(0, 1)),
                     (g[:, None] * h).sum(axis=0), np.array([g.sum()])]
            filters = np.arange(FILTERS)[None, :]
            for p, at in enumerate(where):
                part = back[:, p * FILTERS:(p + 1) * FILTERS]
                for j in range(KERNEL):
                    np.add.at(grads[0][j], (np.take_along_axis(xs, at + j, axis=1), np.broadcast_to(filters, at.shape)), part)
            self.step += 1
            for q, (p, grad) in enumerate(zip(params, grads)):
                m[q] = 0.9 * m[q] + 0.1 * grad
                v[q] = 0.999 * v[q] + 0.001 * grad**2
                p -= rate * (m[q] / (1 - 0.9**self.step)) / (np.sqrt(v[q] / (1 - 0.999**self.step)) + 1e-8)

    def pack(self, rows: int) -> np.ndarray:
        """The state times ``rows``, then ``rows``, in whole numbers: their sums are the same in any order."""
        flat = np.concatenate([*(p.ravel() for p in self.params), *(p.ravel() for p in self.m),
                               *(np.sqrt(p).ravel() for p in self.v), [self.step]])
        return np.append(np.rint(flat * self.PARTS).astype(np.int64) * rows, rows)

    def mean(self, total: np.ndarray) -> Adam:
        """The weighted mean of packed states of this one's shape, from their sum."""
        flat = total[:-1] / total[-1] / self.PARTS
        parts, at = [], 0
        for _ in range(3):
            for p in self.params:
                parts.append(flat[at:at + p.size].reshape(p.shape))
                at += p.size
        n = len(self.params)
        return Adam(parts[:n], parts[n:2 * n], [p**2 for p in parts[2 * n:]], float(flat[at]))


@dataclass
class SecretModel:
    """The network, its calibration (slope, intercept) and the threshold on the calibrated probability."""

    net: CharCNN
    slope: float
    intercept: float
    threshold: float

    def probability(self, windows: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.net.margin(encode(windows)) + self.intercept)))


def calibrate(margins: DataFrame, pos: int, neg: int, rounds: int = 50) -> tuple[float, float]:
    """Platt scaling with smoothed targets by Newton's method on all rows of ``margins`` (label, margin), of
    which ``pos`` and ``neg`` have label 1 and 0; classes weigh alike. Each round is one sum over the rows."""
    one, margin = F.col("label") == 1, F.col("margin")
    target = F.when(one, F.lit((pos + 1) / (pos + 2))).otherwise(F.lit(1 / (neg + 2)))
    weight = F.when(one, F.lit(0.5 * (pos + neg) / pos)).otherwise(F.lit(0.5 * (pos + neg) / neg))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) * margin + F.lit(b))))
        rows = margins.select("margin", ((p - target) * weight).alias("e"), ((p * (1 - p) + 1e-9) * weight).alias("w"))
        s = rows.agg(*[F.sum(c).alias(n) for n, c in (("em", F.col("e") * margin), ("e", F.col("e")), ("wmm", F.col("w") * margin * margin),
                                                      ("wm", F.col("w") * margin), ("w", F.col("w")))]).first()
        g = (s["em"] + 1e-3 * a, s["e"] + 1e-3 * b)
        h = ((s["wmm"] + 1e-3, s["wm"]), (s["wm"], s["w"] + 1e-3))
        det = h[0][0] * h[1][1] - h[0][1] ** 2
        da, db = (h[1][1] * g[0] - h[0][1] * g[1]) / det, (h[0][0] * g[1] - h[0][1] * g[0]) / det
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
        if max(abs(da), abs(db)) < 1e-9:
            break
    return max(a, 1e-3), b


def order_statistic(values: DataFrame, rank: int, bins: int = 4096) -> float:
    """The value at 0-based ``rank`` of the double column ``v``, exactly: bins are counted within the
    bounds of the one that holds the rank until that bin holds one value. The driver gets ``bins`` rows at most."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        at = F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * (bins - 1))
        rows = values.where(F.col("v").between(low, high)).groupBy(at.alias("b")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for r in sorted(rows.collect(), key=lambda r: r["b"]):
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    return low


def recall_threshold(margins: DataFrame, pos: int, slope: float, intercept: float, min_recall: float) -> float:
    """The highest probability at which ``min_recall`` of the ``pos`` findings are found, but 0.5 at least:
    the recall is a constraint on the findings, not a licence to report what is unlikely."""
    found = margins.where(F.col("label") == 1).select(F.col("margin").alias("v"))
    margin = order_statistic(found, int(np.floor((1 - min_recall) * pos)))
    return max(0.5, float(1 / (1 + np.exp(-(slope * margin + intercept)))))


def _shards(examples: DataFrame, number: int) -> DataFrame:
    """The examples (h, label, window) as ``number`` rows of packed columns, in the order of h and window."""
    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "window"])
        z = [zstandard.compress(d) for d in (b"".join(rows["window"]), rows["label"].to_numpy(np.int8).tobytes(), rows["h"].to_numpy(np.int64).tobytes())]
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "x": [z[0]], "y": [z[1]], "h": [z[2]]})

    placed = examples.withColumn("shard", F.pmod(F.floor(F.col("h") / (8 * ROUNDS)), F.lit(number)))
    placed = placed.repartition(min(number, 4096), "shard")  # as many files as there are shards to train at a time
    return cut(placed.groupBy("shard").applyInPandas(packed, "shard long, x binary, y binary, h binary"), "secret-shards")


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for shard, *z in zip(*(c.to_pylist() for c in b.columns)):
        x, y, h = map(zstandard.decompress, z)
        yield shard, encode([x]), np.frombuffer(y, np.int8).astype(float), np.frombuffer(h, np.int64)


def fit_secret_model(findings: DataFrame, min_recall: float = MIN_RECALL, shard_rows: int = SHARD_ROWS) -> SecretModel | None:
    """``findings``: (h long, label int, window binary), all of which train, or calibrate and set the threshold
    (one in four). None without both labels.

    The examples are parted by hash into shards of a fixed size. In a round each shard makes one pass from
    the common state, and the states' mean, weighted by rows, is the next common state. Findings are in every round;
    plain runs take turns when they are more, so that each is used in one round at least. One shard is plain training."""
    held = F.col("h") % 8 < 2
    count = {(r["label"], r["held"]): r["n"] for r in findings.groupBy("label", held.alias("held")).agg(F.count("*").alias("n")).collect()}
    if len({label for label, _ in count}) < 2:
        return None
    split = len(count) == 4  # both labels on both sides; else all examples train and calibrate
    total = lambda label, side: count.get((label, side), 0) + (0 if split else count.get((label, not side), 0))
    pos, neg = total(1, False), total(0, False)
    turns = min(ROUNDS, max(1, neg // pos))
    weights = 0.5 * (pos + neg / turns) * np.array([turns / neg, 1 / pos])
    shards = _shards(findings, max(1, -(-(pos + neg // turns) // shard_rows)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = sum(np.frombuffer(z.as_py(), np.int64) for b in batches for z in b.column(0))
        if np.ndim(out):
            yield one_row(out.tobytes())

    def trained(state: Adam, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                for shard, x, y, h in _unpacked(b):
                    use = (y == 1) | (h // 8 % turns == turn % turns)
                    if split:
                        use &= h % 8 >= 2
                    x, y, h = x[use], y[use], h[use]
                    if not len(y):
                        continue
                    # Keywords before the value tell assignments apart; half of the findings are shown without them.
                    x[h % 2 == 0, :BEFORE] = 0
                    own = Adam([p.copy() for p in state.params], [p.copy() for p in state.m], [p.copy() for p in state.v], state.step)
                    own.epoch(x, y, weights[y.astype(int)], np.random.default_rng([7, turn, shard]))
                    own = own.pack(len(y))
                    out = own if out is None else out + own
            if out is not None:
                yield one_row(out.tobytes())
        return run

    state = Adam.fresh(CharCNN.fresh())
    for turn in range(ROUNDS):
        z = tree_merge(shards.mapInArrow(trained(state, turn), "z binary"), merge)
        if z is not None:
            state = state.mean(np.frombuffer(z, np.int64))
    net = state.net()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x, y, h in _unpacked(b):
                use = h % 8 < 2 if split else np.ones(len(y), bool)
                yield pa.RecordBatch.from_arrays([pa.array(y[use].astype(np.int32)), pa.array(net.margin(x[use]))], ["label", "margin"])

    margins = cut(shards.mapInArrow(judged, "label int, margin double"), "secret-margins")
    pos, neg = total(1, True), total(0, True)
    slope, intercept = calibrate(margins, pos, neg)
    return SecretModel(net, slope, intercept, recall_threshold(margins, pos, slope, intercept, min_recall))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_recall: float = MIN_RECALL) -> DataFrame:
    """One row per input row: doc_id, spans array<struct<start, end, kind, p>> by start, then kind as listed.

    The texts are read once. Every base finding and every further candidate leaves
    its span and surroundings; the network learns from all base findings and
    plain runs of different surroundings, then judges every candidate of every text. Base spans always stay; further
    candidates (kind model) are reported at the calibrated threshold. Offsets are
    code points, end exclusive. Defined cases: null text is empty and has no
    spans; repeated rows have equal spans; a null id stays null; without findings of
    both labels no candidate is added; an empty table gives no rows.
    """
    spark = docs.sparkSession
    schema = ("doc_id long, h long, start array<int>, stop array<int>, kind array<int>, window array<binary>, "
              "plain array<binary>")

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for t in b.column(2).to_pylist():
            t = t or ""
            base, more = candidates(t)
            spans = base + more
            for col, v in zip(cols, ([s for s, _, _ in spans], [e for _, e, _ in spans], [KINDS.index(k) for *_, k in spans],
                                     [context(t, s, e) for s, e, _ in spans], [context(t, s, e) for s, e in plain_runs(t)])):
                col.append(v)
        ints, binary = pa.list_(pa.int32()), pa.list_(pa.binary())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, (ints, ints, ints, binary, binary)))],
                                          ["doc_id", "h", "start", "stop", "kind", "window", "plain"])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.xxhash64(F.col(f"`{id_col}`").cast("long")).alias("h"), text.alias("t"))
    found = cut(map_arrow(rows, scan, schema), "secret-candidates")
    positive = found.select(F.explode(F.arrays_zip("window", "kind")).alias("w")).where(
        F.col("w.kind") < KINDS.index("model")).select(F.col("w.window").alias("window"), F.lit(1).alias("label"))
    negative = found.select(F.explode("plain").alias("window"), F.lit(0).alias("label"))
    examples = positive.union(negative).distinct().withColumn("h", F.xxhash64("window") % (1 << 40))
    model = fit_secret_model(cut(examples.select(F.abs("h").alias("h"), "label", "window"), "secret-examples"), min_recall)
    shared = share(spark, model)
    out = "doc_id long, spans array<struct<start:int,stop:int,kind:string,p:double>>"

    def judge(b: pa.RecordBatch) -> pa.RecordBatch:
        m, spans = shared(), []
        start, stop, kind, window = (b.column(i).to_pylist() for i in range(1, 5))
        flat = [w for ws in window for w in ws]
        p = iter(m.probability(flat).tolist() if m and flat else [0.0] * len(flat))
        for s, e, k in zip(start, stop, kind):
            own = [{"start": a, "stop": z, "kind": KINDS[q], "p": next(p)} for a, z, q in zip(s, e, k)]
            own = [x for x in own if x["kind"] != "model" or m and x["p"] >= m.threshold]
            spans.append(sorted(own, key=lambda x: (x["start"], KINDS.index(x["kind"]))))
        kind_of = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("p", pa.float64())]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind_of)], ["doc_id", "spans"])

    return map_arrow(found.select("doc_id", "start", "stop", "kind", "window"), judge, out)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "model")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), count("model").alias("n_model"))
