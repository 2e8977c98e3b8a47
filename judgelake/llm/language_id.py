"""Language identification by Bayesian fusion of evidence (operator 1)."""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import cut, map_arrow, one_row, table, text_batches, tree_merge
from judgelake.llm.words import WordHashes

#: Labelled documents that train the text model.
MAX_TRAIN_ROWS = 20_000
#: Hash buckets of words and word parts.
BUCKETS = 1 << 14
#: The text's log-likelihood counts at most like this many independent words: neighbouring words are not independent.
TEXT_WEIGHT = 40.0
#: Pseudo-pages that a parent level lends to its child: global -> suffix -> domain -> host.
PRIOR_PAGES = 5.0
#: Pseudo-counts of the declared-language table.
MARKUP_PSEUDO = 0.5

_DROP = re.compile(r"<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def visible_text(page: str | None) -> str:
    return htmllib.unescape(_DROP.sub(" ", page or ""))


def address(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix) in lower case; empty where the address has none."""
    m = _HOST.match((url or "").strip())
    host = m[1].lower().strip(".") if m else ""
    parts = host.split(".")
    return host, ".".join(parts[-2:]), parts[-1] if len(parts) > 1 else ""


def features(text: str) -> list[str]:
    """Words in lower case and their first and last three letters."""
    out = []
    for w in _WORD.findall(text.lower()):
        out += (w, "^" + w[:3], w[-3:] + "$")
    return out


@dataclass
class TextModel:
    languages: list[str]
    logp: np.ndarray  # bucket x language

    def loglik(self, text: str, hashes: WordHashes) -> tuple[np.ndarray, int]:
        """Log-likelihood of a whole text for each language, and its number of words."""
        at = (hashes.of(features(text)) % np.uint64(len(self.logp))).astype(np.int64)
        if not len(at):
            return np.zeros(len(self.languages)), 0
        counts = np.bincount(at)
        used = np.flatnonzero(counts)
        return (counts[used, None] * self.logp[used]).sum(axis=0) / 3, len(at) // 3


def fit_text_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   max_rows: int = MAX_TRAIN_ROWS, buckets: int = BUCKETS) -> TextModel | None:
    """Multinomial model over hashed features from at most ``max_rows`` labelled documents, by a hash of the id.

    None if no row has a label."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"),
                    F.lower(F.col(f"`{lang_col}`").cast("string")).alias("lang")).where("lang is not null and id is not null")
    ids = d.select("id").orderBy(F.xxhash64("id"), "id").limit(max_rows).distinct()
    sample = cut(d.join(ids, "id", "left_semi").select("t", "lang"), "lang-sample")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not languages:
        return None
    shape = (len(languages), buckets)
    text_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(shape)
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = (hashes.of(features(t or "")) % np.uint64(buckets)).astype(np.int64)
                total[languages.index(lang)] += np.bincount(at, minlength=buckets)
        yield one_row(zstandard.compress(total.tobytes()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for z in b.column(0):
                total += np.frombuffer(zstandard.decompress(z.as_py())).reshape(shape)
        yield one_row(zstandard.compress(total.tobytes()))

    z = tree_merge(sample.mapInArrow(count, "z binary"), merge)
    counts = np.frombuffer(zstandard.decompress(z)).reshape(shape) + 0.1
    return TextModel(languages, np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T))


def identify_languages(pages: DataFrame, model: TextModel | None, id_col: str = "page_id", url_col: str = "url",
                       html_col: str = "html") -> DataFrame:
    """One row per input row: key, page_id, host, declared, text_lang, lang, posterior.

    log posterior = log host prior + log P(declared | language) + weighted text
    log-likelihood. Host priors are smoothed towards the domain's, the address
    suffix's and the whole input's shares; all shares and the declared table are
    grouped sums of the pages' text posteriors, from which a page's own share is
    taken out before it is judged. Defined cases: null html is empty and is judged
    by its address alone; a null or odd address has an empty host, whose pages
    share one prior; repeated rows are judged alike; without a model the
    declared language stands, posterior null; an empty table gives no rows.
    """
    rows = pages.select(F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{url_col}`").cast("string"),
                                   F.col(f"`{html_col}`").cast("string")).alias("key"),
                        F.col(f"`{id_col}`").cast("long").alias("page_id"),
                        F.col(f"`{url_col}`").cast("string").alias("u"), F.col(f"`{html_col}`").cast("string").alias("t"))
    languages = model.languages if model else []
    n_lang = len(languages)

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes, out = WordHashes(), []
        for key, i, url, page in zip(*(c.to_pylist() for c in b.columns)):
            m = _DECLARED.search(page or "")
            ll = [0.0] * n_lang
            if model:
                own, n = model.loglik(visible_text(page), hashes)
                own = (own - own.max()) * min(1.0, TEXT_WEIGHT / n) if n else own
                ll = own.tolist()
            out.append((key, i, *address(url), m[1].lower() if m else "", ll))
        cols = list(zip(*out))
        types = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          ["key", "page_id", "host", "domain", "suffix", "declared", "ll"])

    read_pages = cut(map_arrow(rows, read, "key long, page_id long, host string, domain string, suffix string, "
                                           "declared string, ll array<double>"), "lang-pages")
    names = F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>")
    if not model:
        lang = F.when(F.col("declared") != "", F.col("declared"))
        return read_pages.select("key", "page_id", "host", "declared", F.lit(None).cast("string").alias("text_lang"),
                                 lang.alias("lang"), F.lit(None).cast("double").alias("posterior"))

    def softmax(c):
        e = F.transform(c, lambda x: F.exp(x - F.array_max(c)))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))

    soft = cut(read_pages.withColumn("p", softmax(F.col("ll"))), "lang-soft")

    def sums(*by: str) -> DataFrame:
        parts = [F.sum(F.col("p")[i]) for i in range(n_lang)]
        return soft.groupBy(*by).agg(F.array(*parts).alias("n")) if by else soft.agg(F.array(*parts).alias("n"))

    total = [float(x or 0.0) for x in (sums().first()["n"] or [0.0] * n_lang)]
    # Host -> domain -> suffix is a chain of narrow tables; a page then meets one row of its host.
    levels = (sums("host", "domain", "suffix").withColumnRenamed("n", "n_host")
              .join(sums("domain").withColumnRenamed("n", "n_domain"), "domain")
              .join(sums("suffix").withColumnRenamed("n", "n_suffix"), "suffix")
              .select("host", "n_host", "n_domain", "n_suffix"))
    declared = sums("declared").withColumnRenamed("n", "n_declared")
    joined = soft.join(levels, "host").join(declared, "declared")
    everything = F.array(*[F.lit(x) for x in total])

    def without_own(n):
        return F.transform(F.arrays_zip(n.alias("n"), F.col("p").alias("p")), lambda s: F.greatest(s["n"] - s["p"], F.lit(0.0)))

    def smooth(n, parent):
        own = without_own(n)
        all_own = F.aggregate(own, F.lit(0.0), lambda a, y: a + y)
        return F.transform(F.arrays_zip(own.alias("o"), parent.alias("q")),
                           lambda s: (s["o"] + PRIOR_PAGES * s["q"]) / (all_own + PRIOR_PAGES))

    flat = F.array(*[F.lit(1.0 / n_lang)] * n_lang)
    out = joined.withColumn("prior", smooth(everything, flat))
    for level in ("n_suffix", "n_domain", "n_host"):
        out = out.withColumn("prior", smooth(F.col(level), F.col("prior")))
    # P(declared | language): the pages of a language that declare this value, among all its pages.
    out = out.withColumn("markup", F.transform(
        F.arrays_zip(without_own(F.col("n_declared")).alias("d"), without_own(everything).alias("a")),
        lambda s: (s["d"] + MARKUP_PSEUDO) / (s["a"] + MARKUP_PSEUDO * (n_lang + 1))))
    out = out.withColumn("log", F.transform(F.arrays_zip("ll", "prior", "markup"),
                                            lambda s: s["ll"] + F.log(s["prior"]) + F.log(s["markup"])))
    out = out.withColumn("post", softmax(F.col("log")))
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    return out.select("key", "page_id", "host", "declared", best("p").alias("text_lang"), best("post").alias("lang"),
                      F.array_max("post").alias("posterior"))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    model = fit_text_model(table(spark, sf_dir, "documents"))
    return identify_languages(table(spark, sf_dir, "pages"), model).select(
        "page_id", "host", "declared", "text_lang", "lang", "posterior")
