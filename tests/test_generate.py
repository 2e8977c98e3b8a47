"""Keyed permutations and partitions of any size."""

import time
from collections import Counter

from judgelake.operators import generate, ordered
from pyspark.sql import functions as F

GROUPS = "group_id long, size long, total long, min_part long"


def test_permutation_is_one_for_every_span(spark):
    spans = [1, 2, 3, 5, 7, 16, 17, 63, 64, 65, 100, 1000, 4096, 4097]
    df = spark.createDataFrame([(s, k) for s in spans for k in (1, 2)], "span long, k long")
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("span") - 1)))
    got = df.select("span", "k", "i", generate.keyed_permutation(F.col("i"), F.col("span"), 9, F.col("k")).alias("p")).collect()
    seen = {}
    for r in got:
        seen.setdefault((r.span, r.k), []).append(r.p)
    assert all(sorted(v) == list(range(s)) for (s, _), v in seen.items())
    assert seen[1000, 1] != seen[1000, 2] and seen[1000, 1] != list(range(1000))


def test_first_values_are_spread(spark):
    """Over many keys the first two places of 0..5 take each ordered pair about as often."""
    df = spark.range(6000).withColumnRenamed("id", "k")
    p = [generate.keyed_permutation(F.lit(i), F.lit(6), 1, F.col("k")) for i in (0, 1)]
    n = Counter((r[0], r[1]) for r in df.select(*p).collect())
    assert len(n) == 30 and 140 < min(n.values()) and max(n.values()) < 260


def test_only_the_draws_are_made(spark):
    rows = [(1, 5, 10 ** 12, 1), (2, 3, 3 * 10 ** 15, 10 ** 14), (3, 1, 7, 2), (4, 0, 0, 0), (5, 4, 3, 1), (6, 300, 900, 0)]
    df = generate.random_partition(spark.createDataFrame(rows, GROUPS), 5)
    begun = time.time()
    got = {}
    for r in df.collect():
        got.setdefault(r.group_id, {})[r.part_no] = r.part
    assert time.time() - begun < 20
    assert set(got) == {1, 2, 3, 6}
    for g, size, total, least in rows:
        if g in got:
            assert sorted(got[g]) == list(range(size)) and sum(got[g].values()) == total and min(got[g].values()) >= least
    assert max(got[1].values()) > 10 ** 10


def test_blocks_and_ranges_do_not_change_the_parts(spark, monkeypatch):
    g = spark.createDataFrame([(1, 400, 5000, 1), (2, 7, 50, 0)], GROUPS)
    whole = sorted(map(tuple, generate.random_partition(g, 3).collect()))
    monkeypatch.setattr(generate, "DRAW_BLOCK", 16)
    assert sorted(map(tuple, generate.random_partition(g, 3).collect())) == whole


def test_previous_row_over_parts(spark):
    rows = [(None if k == 2 else k, v * 3) for k in range(4) for v in range(500 if k == 1 else 20)]
    got = ordered.previous_row(spark.createDataFrame(rows, "k long, v long"), ["k"], "v", "rank", "prev").collect()
    assert all(r.rank == r.v // 3 and r.prev == (r.v - 3 if r.v else None) for r in got) and len(got) == len(rows)


def test_partition_draws_are_made_once_and_spread(spark, monkeypatch):
    from judgelake.operators import generate as GEN
    seen, real = [], GEN.written

    def noted(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)
    monkeypatch.setattr(GEN, "written", noted)
    groups = spark.createDataFrame([(k, 5, 100, 2) for k in range(8)], "group_id long, size long, total long, min_part long")
    got = GEN.random_partition(groups, 3).groupBy("group_id").sum("part").collect()
    assert len(got) == 8 and all(r[1] == 100 for r in got)
    assert len(seen) == 1 and "REPARTITION_BY_NUM" in seen[0]
