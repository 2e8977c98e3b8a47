"""Toxicity scores: boosted trees over dense text features (operator 7)."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import crc_mod, cut, map_arrow, table

#: Labelled rows used to learn the lexicon, the trees and the calibration.
MAX_TRAIN_ROWS = 20_000
MAX_LEXICON = 96
PREFIX_LENGTHS = (4, 5, 6)
NEAR_WORDS = 40  # characters either side of a lexicon hit searched for a second-person word
THRESHOLD = 0.3

#: Insults known before any label is read.
SEED_LEXICON = ("clown", "disgusting", "dumb", "fool", "idiot", "jerk", "loser", "moron", "pathetic", "scum",
                "stupid", "trash", "ugly", "worthless")
#: Second-person words of the four languages.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
                 "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes")

FEATURES = ("hits", "hit_density", "distinct_hits", "obfuscated_hits", "second_person_density", "hits_near_second_person",
            "capital_rate", "shouted_rate", "exclaim_rate", "question_rate", "punct_rate", "obfuscation_rate",
            "stretched_rate", "log_words", "weight_sum", "weight_max")

_WORD = re.compile(r"[^\W\d_]+")
_SECOND = re.compile(r"\b(?:" + "|".join(SECOND_PERSON) + r")\b")
_OBFUSCATED = re.compile(r"\b\w*[^\W\d_][@$!*|013457]+[^\W\d_]\w*")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_SHOUTED = re.compile(r"\b[A-Z]{3,}\b")
_LEET = str.maketrans("@$!|013457", "asiioieast", "*")


def terms(text: str) -> set[str]:
    """Words of a text in lower case, and their prefixes marked with a trailing ``+``."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w)
        out.update(w[:n] + "+" for n in PREFIX_LENGTHS if len(w) >= n)
    return out


def choose_lexicon(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int,
                   limit: int = MAX_LEXICON) -> dict[str, float]:
    """Terms over-represented in toxic documents with their log-odds.

    A term inside a chosen prefix adds nothing and is left out. Order:
    document count in the toxic class, then shorter, then by spelling.
    """
    least = max(3, n_toxic // 500)
    scored = []
    for term, tox, clean in counts:
        if tox >= least:
            odds = math.log((tox + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
            if odds > 2.0:
                scored.append((-tox, len(term), term, odds))
    chosen: dict[str, float] = {}
    for _, _, term, odds in sorted(scored):
        word = term.rstrip("+")
        if len(chosen) < limit and not any(word[:n] + "+" in chosen for n in PREFIX_LENGTHS if n <= len(word)):
            chosen[term] = odds
    return chosen


class Featurizer:
    """Dense features of one text. ``lexicon`` maps words and ``prefix+`` terms to weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = dict(lexicon)
        self._find = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "_find": None}

    def _automaton(self):
        if self._find is None:
            self._find = ahocorasick.Automaton()
            for term, w in self.lexicon.items():
                self._find.add_word(term.rstrip("+"), (term.endswith("+"), len(term.rstrip("+")), w, term))
            self._find.make_automaton()
        return self._find

    def hits(self, low: str) -> list[tuple[int, int, float, str]]:
        """(start, end, weight, term) of lexicon terms that begin a word (and end it, for whole words)."""
        if not self.lexicon:
            return []
        out = []
        for last, (prefix, n, w, term) in self._automaton().iter(low):
            i = last - n + 1
            if (i == 0 or not low[i - 1].isalpha()) and (prefix or last + 1 == len(low) or not low[last + 1].isalpha()):
                out.append((i, last + 1, w, term))
        return out

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        words = max(1, low.count(" ") + low.count("\n") + 1)
        chars = max(1, len(text))
        found = self.hits(low)
        odd = _OBFUSCATED.findall(low)
        masked = [h for w in odd for h in self.hits(w.translate(_LEET))]
        second = len(_SECOND.findall(low))
        near = sum(bool(_SECOND.search(low, max(0, i - NEAR_WORDS), min(len(low), j + NEAR_WORDS))) for i, j, _, _ in found)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        capitals = int(((codes >= 65) & (codes <= 90)).sum())
        punct = int(((codes >= 33) & (codes <= 47)).sum())
        weights = [w for _, _, w, _ in found] + [w for _, _, w, _ in masked]
        return [len(found), len(found) / words, len({t for *_, t in found}), len(masked), second / words, near,
                capitals / chars, len(_SHOUTED.findall(text)) / words, low.count("!") / words, low.count("?") / words,
                punct / chars, len(odd) / words, len(_STRETCHED.findall(low)) / words, math.log(words),
                sum(weights), max(weights, default=0.0)]


@dataclass
class Trees:
    """Gradient boosting for log loss with histogram splits."""

    rounds: int = 80
    depth: int = 3
    bins: int = 32
    rate: float = 0.15
    min_rows: int = 10
    l2: float = 1.0
    base: float = 0.0
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = math.log(p / (1 - p))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # Rare features are zero nearly everywhere: their quantiles alone would hide all other values.
        self.edges = [np.unique(np.concatenate([e, np.quantile(c[c != 0], [0, .25, .5, .75])])) if (c != 0).any() else e
                      for e, c in zip(self.edges, x.T)]
        binned = self._bin(x)
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, q - y, q * (1 - q))
            self.trees.append(tree)
            margin += self._walk(tree, binned)
        return self

    def _bin(self, x):
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def _grow(self, b, g, h):
        nodes = []

        def leaf(rows):
            nodes.append((-1, 0, 0, 0, -self.rate * g[rows].sum() / (h[rows].sum() + self.l2)))
            return len(nodes) - 1

        def split(rows, depth):
            if depth == 0 or len(rows) < 2 * self.min_rows:
                return leaf(rows)
            G, H = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            for f in range(b.shape[1]):
                n = len(self.edges[f]) + 1
                col = b[rows, f]
                cg = np.cumsum(np.bincount(col, g[rows], n))[:-1]
                ch = np.cumsum(np.bincount(col, h[rows], n))[:-1]
                cn = np.cumsum(np.bincount(col, minlength=n))[:-1]
                gain = cg**2 / (ch + self.l2) + (G - cg)**2 / (H - ch + self.l2) - G**2 / (H + self.l2)
                gain[(cn < self.min_rows) | (len(rows) - cn < self.min_rows)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
            if best[1] < 0:
                return leaf(rows)
            low = b[rows, best[1]] <= best[2]
            at = len(nodes)
            nodes.append(None)
            nodes[at] = (best[1], best[2], split(rows[low], depth - 1), split(rows[~low], depth - 1), 0.0)
            return at

        split(np.arange(len(g)), self.depth)
        return [np.array(c) for c in zip(*nodes)]

    def _walk(self, tree, b):
        feature, cut_at, low, high, value = tree
        at = np.zeros(len(b), int)
        for _ in range(self.depth):
            f = feature[at]
            go = np.where(b[np.arange(len(b)), np.maximum(f, 0)] <= cut_at[at], low[at], high[at])
            at = np.where(f < 0, at, go)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.base + sum((self._walk(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), each block shrunk by half a row of each class."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # low, high, positives, rows
    for s, v in zip(score[order], y[order]):
        if blocks and blocks[-1][1] == s:
            blocks[-1][2] += v
            blocks[-1][3] += 1
        else:
            blocks.append([s, s, v, 1])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            lo, hi, p, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + p, blocks[-1][3] + n]
    xs, ps = [], []
    for lo, hi, p, n in blocks:
        q = (p + 0.5 * y.mean()) / (n + 0.5)
        xs += [lo, hi] if hi > lo else [lo]
        ps += [q, q] if hi > lo else [q]
    return np.array(xs), np.maximum.accumulate(np.array(ps))


@dataclass
class ToxicityModel:
    featurizer: Featurizer
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.featurizer(t) for t in texts], float).reshape(-1, len(FEATURES))
        if self.trees is None:
            return np.where(x[:, 0] + x[:, 3] > 0, 0.5, 0.0)
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0.0, 1.0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled training rows, taken in the order of a hash of the id.

    Training rows: crc32(id as text) mod 4 is not 2. Only ids and labels are
    sampled; the lexicon's counts are aggregated by Spark, and what reaches the
    driver is the lexicon's best terms and one feature row for each sampled row.
    With fewer than two classes the model is the seed lexicon alone.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    y = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
         .where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
         .where(crc_mod(F.col("id"), 4) != 2))
    # Twice the rows are drawn, as labels may name documents that an earlier stage dropped.
    drawn = y.orderBy(F.xxhash64("id"), "id").limit(2 * max_rows)
    known = d.select("id").where("id is not null").distinct()
    ids = drawn.join(known, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    sample = cut(d.join(ids, "id").dropDuplicates(["id"]), "toxicity-sample")
    by_class = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_tox, n_clean = by_class.get(1, 0), by_class.get(0, 0)
    seeds = dict.fromkeys(SEED_LEXICON, 4.0)
    if not n_tox or not n_clean:
        return ToxicityModel(Featurizer(seeds), None, None)

    def count_terms(b: pa.RecordBatch) -> pa.RecordBatch:
        by = {0: Counter(), 1: Counter()}
        for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by[min(1, max(0, label))].update(terms(t or ""))
        keys = list(by[0].keys() | by[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([by[1][k] for k in keys], pa.int64()),
             pa.array([by[0][k] for k in keys], pa.int64())], ["term", "tox", "clean"])

    least = max(3, n_tox // 500)
    counted = (map_arrow(sample.select("t", "y"), count_terms, "term string, tox long, clean long")
               .groupBy("term").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
               .where((F.col("tox") >= least) & (F.col("tox") * n_clean > 7 * F.col("clean") * n_tox))
               .orderBy(F.desc("tox"), F.length("term"), "term").limit(50 * MAX_LEXICON))
    learned = choose_lexicon([tuple(r) for r in counted.collect()], n_tox, n_clean)
    featurizer = Featurizer(seeds | learned)

    def featurize(b: pa.RecordBatch) -> pa.RecordBatch:
        x = pa.array([featurizer(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([b.column(0), x, b.column(2)], ["h", "x", "y"])

    rows = (map_arrow(sample.select(F.xxhash64("id").alias("h"), "t", "y"), featurize, "h long, x array<double>, y int")
            .toPandas().sort_values("h", kind="stable"))
    x, y, fold = np.array(rows["x"].tolist(), float), rows["y"].clip(0, 1).to_numpy(float), rows["h"].to_numpy() % 4
    hold = fold == 0
    if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
        hold = np.zeros(len(y), bool)
    trees = Trees().fit(x[~hold], y[~hold])
    cal = hold if hold.any() else ~hold
    return ToxicityModel(featurizer, trees, isotonic(trees.margin(x[cal]), y[cal]))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs`` with score double (0 to 1) and predicted int.

    Features per text: lexicon densities, hits beside second-person words,
    capitals, punctuation, masked and stretched spellings. Defined cases: a null
    text counts as empty and gets the score of an empty text; repeated rows get
    equal scores; no labels at all leave the seed lexicon (0.5 with a hit, else
    0); an empty table gives no rows. Columns named score or predicted are replaced.
    """
    @F.pandas_udf("double")
    def score(t):
        import pandas as pd
        return pd.Series(model.score(t.tolist()), dtype="float64")

    from judgelake.llm.common import text_batches
    text_batches(docs.sparkSession)
    out = docs.withColumn("score", score(F.col(f"`{text_col}`").cast("string")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    out = toxicity_scores(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go; the rest keep their columns."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    # Scored under other names, so that a column of the documents called score stays.
    scored = toxicity_scores(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                                         F.col("text")), model)
    return scored.where("predicted = 0").select("row.*")
