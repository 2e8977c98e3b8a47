"""C4 in committed batches, U4 with a store of results."""

import random

from judgelake import constants as K
from judgelake.operators import curate, resume, udfs
from judgelake.session import scratch_path
from judgelake.sources.files import CANDIDATE_SCHEMA
from judgelake.streaming import deltas
from pyspark.sql import functions as F

COMPILES = "code_hash string, standard string, ok boolean"


class Counting:
    """Accepts a code unless it holds 'bad'; 'lost' is a transport failure. Remembers what it was asked."""

    def __init__(self):
        self.asked = []

    def evaluate(self, requests):
        self.asked.append(sorted(r[0] for r in requests.select(F.concat_ws("/", "problem_id", "code")).collect()))
        return requests.select("request_id", F.when(F.col("code").contains("bad"), K.WRONG_ANSWER).otherwise(K.ACCEPTED).alias("verdict"),
                               (~F.col("code").contains("lost")).alias("success"))


def problem(pid, incorrect, correct=("ok",)):
    def subs(codes):
        return [(("python" if c.startswith("py") else "cpp"), c) for c in codes]
    return (pid, [("1", "2")], subs(incorrect), subs(correct), f"about {pid}", 0.5, 0.5, None, 1000, 256)


def compile_log(spark, codes=("ok",)):
    rows = spark.createDataFrame([(c,) for c in codes], "c string")
    return rows.select(F.md5("c").alias("code_hash"), F.lit("c++17").alias("standard"), F.lit(True).alias("ok"))


def as_dict(df):
    return {r.id: (list(r.incorrect_codes), r.correct_code) for r in df.collect()}


def test_store_evaluates_each_key_once(spark):
    rows = [problem("1_A", ["a", "bad", "a", "py x", "lost"]), problem("2_B", ["a", "b"], [" ", "ok"]), problem("3_C", ["bad"])]
    inner = Counting()
    store = udfs.StoredEvaluator(inner, scratch_path(spark, f"test-store-{random.random()}"))
    df = spark.createDataFrame(rows, CANDIDATE_SCHEMA)
    want = {"1_A": (["a", "a"], "ok"), "2_B": (["a", "b"], "ok")}
    assert as_dict(curate.passed_incorrect_evaluated(df, store, compile_log(spark))) == want
    assert inner.asked == [["1_A/a", "1_A/bad", "1_A/lost", "1_A/ok", "2_B/a", "2_B/b", "2_B/ok", "3_C/bad", "3_C/ok"]]
    assert as_dict(curate.passed_incorrect_evaluated(df, store, compile_log(spark))) == want
    assert inner.asked[1:] == [["1_A/lost"]]  # a failed request is tried again, nothing else is
    more = spark.createDataFrame(rows[1:] + [problem("4_D", ["a"])], CANDIDATE_SCHEMA)
    curate.passed_incorrect_evaluated(more, store, compile_log(spark)).collect()
    assert inner.asked[2:] == [["4_D/a", "4_D/ok"]]


def test_evaluated_and_logged_curation_agree(spark):
    rng = random.Random(2)
    rows = [problem(f"{k}_A", [rng.choice(["a", "bad", "py", "b"]) + str(rng.randint(0, 3)) for _ in range(5)],
                    [rng.choice(["ok", "bad ok", " ", "no compile"]) for _ in range(3)]) for k in range(30)]
    df = spark.createDataFrame(rows, CANDIDATE_SCHEMA)
    log = curate.listed_submissions(df, "code").select(
        "id", "kind", "pos", F.when(F.col("code").contains("bad"), K.WRONG_ANSWER).otherwise(K.ACCEPTED).alias("verdict"))
    store = udfs.StoredEvaluator(Counting(), scratch_path(spark, f"test-store-{random.random()}"))
    got = as_dict(curate.passed_incorrect_evaluated(df, store, compile_log(spark)))
    assert got == as_dict(curate.passed_incorrect_single(df, log, compile_log(spark)))
    want = {}
    for pid, _, inc, cor, *_ in rows:
        codes = [c for lang, c in inc if lang == "cpp" and "bad" not in c]
        if codes:
            want[pid] = (codes, next((c for _, c in cor if c == "ok"), None))
    assert got == want


def test_batches_go_on_behind_the_last_commit(spark):
    base = scratch_path(spark, f"test-resume-{random.random()}")
    parts = [[problem(f"{10 * f + k}_{'ABC'[f]}", ["a", "bad"] if k % 2 else ["bad"]) for k in range(4)] for f in range(3)]
    parts[1].append(problem("no underscore", ["a"]))
    for rows in parts:
        spark.createDataFrame(rows, CANDIDATE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    files = list(spark.read.parquet(f"{base}/in").inputFiles())
    inner, seen = Counting(), []

    def job(p):
        seen.append(sorted(r.id for r in p.select("id").collect()))
        seen.append(p.inputFiles())
        return curate.passed_incorrect_evaluated(p, inner, compile_log(spark))

    def run(limit=None):
        return resume.resume_batches(spark, files, CANDIDATE_SCHEMA, f"{base}/state", job, limit=limit)
    assert resume.records(spark, f"{base}/state") is None
    assert run(limit=1) == 1
    first = set(seen[0])
    assert len(first) == 4 and {r.problem_id for r in resume.state(spark, f"{base}/state").collect()} == first

    def failing(p):
        raise RuntimeError("stopped")
    try:
        resume.resume_batches(spark, files, CANDIDATE_SCHEMA, f"{base}/state", failing)
    except RuntimeError:
        pass
    assert {r.problem_id for r in resume.state(spark, f"{base}/state").collect()} == first
    # output without a commit, as a stop between the two leaves it, is written anew
    spark.createDataFrame(parts[0], CANDIDATE_SCHEMA).coalesce(1).write.parquet(f"{base}/state/output/batch=1")
    begun = len(inner.asked)
    assert run() == 2
    assert not {a.split("/")[0] for asked in inner.asked[begun:] for a in asked} & first  # no code of a done problem
    assert not set(seen[1]) & {f for k in range(3, len(seen), 2) for f in seen[k]}  # its file is not opened
    everything = {p[0] for rows in parts for p in rows if "_" in p[0]}
    assert {r.problem_id for r in resume.state(spark, f"{base}/state").collect()} == everything
    got = as_dict(resume.records(spark, f"{base}/state"))
    assert got == {p: (["a"], "ok") for p in everything if int(p.split("_")[0]) % 10 % 2}
    assert run() == 0 and as_dict(resume.records(spark, f"{base}/state")) == got
    assert deltas.state_of(spark, f"{base}/state") == (None, [0, 1, 2])
    plan = resume.pending(spark, files, CANDIDATE_SCHEMA, f"{base}/state")._jdf.queryExecution().toString()
    assert "code:string" not in plan.split("== Physical Plan ==")[1]


class ByVersion:
    """A code names the versions that fail it: 'w:c++17' is wrong there, 'x:c++14' does not compile there."""

    def __init__(self):
        self.asked = []

    def evaluate(self, requests):
        self.asked.append(sorted(r[0] for r in requests.select(F.concat_ws("/", "language", "code")).collect()))
        code, version = F.col("code"), F.col("language")
        verdict = (F.when(code.contains(F.concat(F.lit("w:"), version)), K.WRONG_ANSWER)
                    .when(code.contains(F.concat(F.lit("x:"), version)), K.COMPILE_ERROR).otherwise(K.ACCEPTED))
        return requests.select("request_id", verdict.alias("verdict"), (~code.contains("lost")).alias("success"))


def test_versions_are_tried_until_one_fails(spark):
    codes = ["fine", "w:c++14", "x:c++14 w:c++20", "x:c++14 x:c++17 x:c++20 x:c++23", "lost"]
    df = spark.createDataFrame([(k, "p", c) for k, c in enumerate(codes)], "code_id long, problem_id string, code string")
    inner = ByVersion()
    got = {r.code_id: (r.all_passed, r.stopped_at, r.fail_verdict, r.untestable) for r in curate.evaluated_consensus(df, inner).collect()}
    assert got == {0: (True, None, None, False), 1: (False, "c++14", K.WRONG_ANSWER, False), 2: (False, "c++20", K.WRONG_ANSWER, False),
                   3: (True, None, None, True), 4: (False, "c++14", K.SYSTEM_ERROR, False)}
    assert [len(a) for a in inner.asked] == [5, 3, 3, 2]  # nobody asks about a code that has failed


def test_refilter_through_an_evaluator(spark):
    curated = spark.createDataFrame([("1_A", ["fine", "w:c++17", "also fine"]), ("2_B", ["w:c++14"]), ("3_C", ["x:c++14"])],
                                    "id string, incorrect_codes array<string>")
    codes = curated.select(F.col("id").alias("problem_id"), F.posexplode("incorrect_codes").alias("pos", "code"))
    codes = codes.withColumn("code_id", F.concat_ws(":", "problem_id", "pos"))
    store = udfs.StoredEvaluator(ByVersion(), scratch_path(spark, f"test-store-{random.random()}"))
    for _ in range(2):
        cons = curate.evaluated_consensus(codes, store)
        cons = cons.join(codes.select("code_id", F.col("problem_id").alias("id"), "pos"), "code_id")
        kept, rejects = curate.refilter_codes(curated, cons)
        assert {r.id: r.incorrect_codes for r in kept.collect()} == {"1_A": ["fine", "also fine"], "3_C": ["x:c++14"]}
        assert {(r.problem_id, r.reject_no, r.pos, r.code, r.stopped_at) for r in rejects.collect()} == {
            ("1_A", 1, 1, "w:c++17", "c++17"), ("2_B", 1, 0, "w:c++14", "c++14")}
    assert len(store.inner.asked) == 4  # the second time the store answers
