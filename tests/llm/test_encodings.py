"""Whitening, periodic runs and piece encoding against brute force and the library."""

import random
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from judgelake.llm import periodic_runs, piece_bpe, whitening
from judgelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, runs string, ids string, decoded int, n_words int"


def docs(spark, rows):
    """Rows with columns that clash with names the operators use inside."""
    return spark.createDataFrame([(i, t, "r", "s", 1, 2) for i, t in rows], DOCS)


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


# -- operator 13 ----------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())


def odd_texts():
    rng = random.Random(1)
    pool = ["▁", " ", "  ", "\n", "\t", "a", "b", "the", " t", "é", "🎉", "日本", "\x00", "<s>", "<0x0A>", "1", "\r", "́", "ß", "Ж", *"aeinrst"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return texts + ["", None, " ", " " * 3_000, "a" * 3_000, "the" * 2_000, "▁" * 33 + "x" + " " * 17, "long words " * 20_000, "x", "x"]


def test_pieces_equal_the_library(spark, library):
    rows = [*enumerate(odd_texts()), (None, "no id"), (3, "same id")]
    got = [(r.doc_id, r.ids, r.decoded) for r in piece_bpe.piece_ids(docs(spark, rows)).collect()]
    want = [(i, ids := library.encode(t or ""), library.decode(ids)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert piece_bpe.piece_ids(docs(spark, rows).limit(0)).count() == 0


def test_any_ids_decode_as_the_library_does(library):
    rng = random.Random(2)
    coder = piece_bpe.PieceCoder(piece_bpe.model_path())
    for _ in range(5_000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(260), rng.randrange(3), 259, 28705]) for _ in range(rng.randint(0, 8))]
        assert coder.decode(ids) == library.decode(ids)


def test_memory_of_segments_and_pairs_is_bounded(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "MAX_SEGMENTS", 5)
    monkeypatch.setattr(piece_bpe, "MAX_PAIRS", 5)
    coder = piece_bpe.PieceCoder(piece_bpe.model_path())
    text = "the quick brown fox jumps over the lazy dog, again and again"
    assert np.frombuffer(coder.encode(text), "<i4").tolist() == library.encode(text)
    assert len(coder.segments) <= 5 and len(coder.pairs) <= 5


def test_piece_query_over_documents(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_piece_bpe"](spark, SF).collect()}
    want = {}
    for doc_id, text, *_ in table("documents"):
        ids = library.encode(text or "")
        want[doc_id] = (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest())
    assert got == want


# -- operator 12 ----------------------------------------------------------

def brute_runs(w, least=12):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1 if j > i else i + 1
    return sorted((s, n, p) for (s, n), p in out.items())


def brute_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def shapes():
    rng = random.Random(3)
    fib, thue = "ab", "a"
    for _ in range(8):
        fib = fib + fib[:len(fib) * 5 // 8 + 1]
        thue = thue + thue.translate(str.maketrans("ab", "ba"))
    out = [list(fib[:300]), list(thue[:300]), ["a"] * 400, (["a"] * 40 + ["b"]) * 6, [], ["x"], ["x"] * 11, ["x"] * 12]
    for _ in range(60):
        b = [str(rng.randint(0, 40)) for _ in range(rng.randint(1, 150))]
        edge = [[str(rng.randint(0, 40)) for _ in range(rng.randint(0, 60))] for _ in range(2)]
        out.append(edge[0] + b * rng.randint(2, 5) + b[:rng.randint(0, len(b))] + edge[1])
    out += [[rng.choice("ab") for _ in range(rng.randint(0, 300))] for _ in range(20)]
    return out


def test_runs_against_brute_force(spark):
    texts = shapes()
    rows = [(i, rng_join(w)) for i, w in enumerate(texts)] + [(900, None), (901, ""), (902, " \n\t "), (None, "z " * 20), (0, rng_join(texts[0])),
                                                              (903, "a\x1cb c " * 14), (904, "b c " * 15_000)]
    texts += [[], [], [], ["z"] * 20, texts[0], ["a\x1cb c"] * 14, ["b", "c"] * 15_000]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs(spark, rows)).collect()]
    want = []
    for (i, _), w in zip(rows, texts):
        runs = brute_runs(w) if i != 904 else [(0, 30_000, 2)]
        want.append((i, len(w), runs, brute_collapsed(w, runs)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic_runs.periodic_runs(docs(spark, rows).limit(0)).count() == 0


def rng_join(words):
    """Words joined by blanks of all kinds, the same for the same words."""
    rng = random.Random(len(words))
    return "".join(w + rng.choice([" ", "\n", "\t", "\x0b", "\x0c", "\r", "  "]) for w in words)


def test_transform_is_the_sum_of_squared_differences():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 32, (64, 3)), rng.integers(0, 32, (256, 3))
    ntt = periodic_runs.Ntt(256)
    pattern = np.zeros((256, 3), np.int64)
    pattern[-np.arange(64)] = a
    shared = ntt.backward(ntt.forward(pattern) % 65537 * (ntt.forward(b.copy()) % 65537) % 65537)[:193]
    assert (shared == [[(a[:, c] * b[d:d + 64, c]).sum() for c in range(3)] for d in range(193)]).all()


def test_words_of_equal_hashes_do_not_join(monkeypatch):
    monkeypatch.setattr(periodic_runs._Prefixes, "same", lambda self, a, b, n: np.ones(np.shape(n), bool))
    words = np.array([1, 2, 3] * 10 + [9, 8, 7, 6, 5, 4, 0, 11], np.int64)
    assert [tuple(r) for r in periodic_runs.find_runs(words, np.array([0, len(words)]))] == [(0, 0, 30, 3)]


def test_runs_query_over_documents(spark):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    want, planted = {}, 0
    for doc_id, text, *_ in table("documents"):
        w = [x.decode() for x in (text or "").encode().split()]
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(w)
        s, length, p = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        want[doc_id] = (len(runs), s, length, p, 1000 * length // p if runs else None,
                        sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
                        sha256(brute_collapsed(w, runs).encode()).hexdigest())
    assert planted and got == want


# -- operator 11 ----------------------------------------------------------

def brute_whiten(vectors, count=8):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = n * x.astype(object) - sums.astype(object)
    z = (y / n).astype(float)
    e, u = np.linalg.eigh(z.T @ z / n)
    return n, (y * y).sum(axis=1).tolist(), z, e[::-1][:count], u[:, ::-1][:, :count], e.sum()


def check_whitened(got, ids, vectors, count):
    n, deviation, z, e, u, trace = brute_whiten(vectors)
    assert sorted(r.vec_id for r in got if r.component == 1) == sorted(ids)
    at = {i: k for k, i in enumerate(ids)}
    white = np.zeros((len(ids), count))
    for r in got:
        assert r.n == n and r.deviation == deviation[at[r.vec_id]] and r.identity_error <= 1e-4
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9)
        white[at[r.vec_id], r.component - 1] = r.whitened
    want = z @ u[:, :count] / np.sqrt(e[:count])
    assert np.allclose(white * np.sign((white * want).sum(axis=0)), want, atol=1e-7)


def test_whitening_query_over_embeddings(spark):
    got = QUERIES["op11_whitening"](spark, SF).collect()
    rows = table("embeddings")
    assert len(got) == 8 * len(rows)
    check_whitened(got, [r[0] for r in rows], [r[1] for r in rows], 8)


VECS = "vec_id long, embedding array<double>, n int, v string, whitened string, dim int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 3) for i, v in rows], VECS)


def by_component(df):
    from pyspark.sql import functions as F
    return [type("R", (), dict(vec_id=r.vec_id, n=r.n, deviation=int(r.deviation), component=k + 1, whitened=w, explained=r.explained[k],
                               identity_error=r.identity_error)) for r in df.collect() for k, w in enumerate(r.whitened)]


def test_whitening_of_odd_rows_and_low_rank(spark):
    rng = np.random.default_rng(5)
    good = [(100 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) * [1, 1, 2, 30, 1e-1])]
    bad = [(1, None), (2, []), (3, [1.0, None, 2.0, 3.0, 4.0]), (4, [float("nan")] * 5), (5, [float("inf")] + [0.0] * 4), (6, [1.0, 2.0]),
           (7, [1e300] * 5)]
    check_whitened(by_component(whitening.whiten(vectors(spark, good + bad))), [i for i, _ in good], [v for _, v in good], 5)
    twins = [(i, [v[0], v[0], v[1], 7.0, v[1]]) for i, v in good]  # two independent directions
    check_whitened(by_component(whitening.whiten(vectors(spark, twins))), [i for i, _ in twins], [v for _, v in twins], 2)
    one = vectors(spark, [(1, [1.0, 2.0])] * 3)
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0
    again = whitening.whiten(vectors(spark, good + good[:7] + [(None, good[0][1])]))
    assert again.count() == 308 and again.where("vec_id is null").count() == 1


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(6)
    for size in (3e4, 1e9, 1e14):
        rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 3)) * size)]
        _, deviation, *_ = brute_whiten([v for _, v in rows])
        got = {r.vec_id: int(r.deviation) for r in whitening.whiten(vectors(spark, rows)).collect()}
        assert got == dict(enumerate(deviation))


def test_factor_and_rotations():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(12, 9)) * np.logspace(0, -5, 9)
    a = a @ a.T
    order, factor = whitening.pivoted_cholesky(a)
    assert factor.shape == (12, 9) and np.allclose(factor @ factor.T, a[np.ix_(order, order)]) and np.allclose(factor, np.tril(factor))
    turned = whitening.one_sided_jacobi(factor)
    gram = turned.T @ turned
    assert np.allclose(gram, np.diag(gram.diagonal()), atol=1e-14)
    assert np.allclose(sorted(gram.diagonal()), np.linalg.eigvalsh(a)[3:], rtol=1e-9)
