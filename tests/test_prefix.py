import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.operators import metrics as M
from shardloom.operators import prefix
from shardloom.operators import training as P


def test_running_sums_match_a_plain_loop(spark):
    r = random.Random(1)
    rows = [("a" if i % 10 else r.choice("bcd"), i, r.randrange(50), r.random(), r.choice([None, 1, 2])) for i in range(3000)] + [(None, 5000 + i, i, 0.5, 1) for i in range(40)]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "k string, i long, o long, x double, n long")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix.running_sums(table, ["k"], [F.col("o").desc(), "i"], {"before_x": "x", "before_n": "n"})
        assert got.columns == ["k", "i", "o", "x", "n", "before_x", "before_n"]
        seen = {x.i: (x.before_x, x.before_n) for x in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums = {}
    for k, i, o, x, n in sorted(rows, key=lambda t: (str(t[0]), -t[2], t[1])):
        before = sums.get(k, (0.0, 0))
        assert seen[i][0] == pytest.approx(before[0], abs=1e-9) and seen[i][1] == before[1]
        sums[k] = (before[0] + x, before[1] + (n or 0))
    assert len(seen) == len(rows)
    assert prefix.running_sums(table.limit(0), ["k"], ["i"], {"b": "x"}).count() == 0


def test_a_class_of_most_rows_is_many_ranges(spark, monkeypatch):
    """One class has nine rows of ten, and a third of the scores are equal: no range holds the class."""
    kept = []
    real = prefix.written
    monkeypatch.setattr(prefix, "written", lambda rows, name: kept.append(real(rows, name)) or kept[-1])
    n = 4000
    rows = spark.range(n).select(
        F.lit("A").alias("arm"), F.lit(1).alias("seed"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("true"),
        F.array(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / n), F.lit(0.25)).alias("scores"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.cls: x.ap for x in M.average_precision(rows).collect()}
        most = kept[0].groupBy("_span").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < n / 4
    score = np.array([0.5 if i % 3 == 0 else i / n for i in range(n)])
    hit = np.array([i % 10 != 0 for i in range(n)])
    ap, last = 0.0, 0
    for s in np.unique(score)[::-1]:
        above = score >= s
        ap += (hit[above].sum() - last) / hit.sum() * hit[above].mean()
        last = hit[above].sum()
    assert got[0] == pytest.approx(ap) and got[1] == pytest.approx(0.1)


@pytest.mark.parametrize("range_rows", [1 << 16, 30, 7])
def test_resampled_auprc_of_any_ranges(spark, range_rows):
    r = random.Random(3)
    rows = []
    for arm in "BC":
        for i in range(150):
            t = r.randrange(3)
            rows.append((arm, 1, i, f"g{i // 4}", t, [round(r.random(), 1) if r.random() < 0.6 else 0.5, r.random(), float(t == 2)]))
    p = spark.createDataFrame(rows, "arm string, seed int, item long, `group` string, `true` int, scores array<double>")
    draws = [(k, f"g{g}", r.randint(1, 3)) for k in range(7) for g in range(38) if r.random() < 0.6]
    drawn = spark.createDataFrame(draws, "resample int, `group` string, multiplicity long")
    got = {(x.resample, x.arm): x.macro_auprc for x in M.resampled_auprc(p, drawn, block=3, range_rows=range_rows).collect()}
    want = {}
    for k in range(7):
        times = {g: m for q, g, m in draws if q == k}
        for arm in "BC":
            aps = []
            for c in range(3):
                own = [(x[5][c], x[4] == c, times[x[3]]) for x in rows if x[0] == arm and x[3] in times]
                total = sum(m for _, h, m in own if h)
                ap, last = 0.0, 0
                for s in sorted({s for s, _, _ in own}, reverse=True):
                    f, t = sum(m for v, h, m in own if h and v >= s), sum(m for v, _, m in own if v >= s)
                    ap += (f - last) / total * f / t
                    last = f
                aps.append(ap)
            want[(k, arm)] = pytest.approx(sum(aps) / 3)
    assert got == want


def test_class_pools_number_a_class_without_gaps(spark):
    rows = spark.range(500).select((F.col("id") % 7 == 0).alias("c"), F.col("id").alias("i"), (F.col("id") % 5).alias("r"))
    got = {(x.c, x["index"]): (x.i, x.pool_size) for x in P.class_pools(rows, "i", "c", "r").collect()}
    for c in (True, False):
        own = sorted((i % 5, i) for i in range(500) if (i % 7 == 0) == c)
        assert all(got[(c, k)] == (i, len(own)) for k, (_, i) in enumerate(own))


def test_draws_are_dealt_by_resamples(spark):
    """No task draws all resamples, and each stratum gives as many groups as it has in every one of them."""
    strata = spark.range(0, 300, numPartitions=1).select(F.concat(F.lit("g"), "id").alias("group"), F.when(F.col("id") < 100, "a").otherwise("b").alias("stratum"), F.when(F.col("id") < 100, F.col("id")).otherwise(F.col("id") - 100).alias("index"), F.when(F.col("id") < 100, 100).otherwise(200).alias("size"))
    drawn = M.bootstrap_draws(strata, 250, 1)
    assert {(x.s, x.r): x.n for x in drawn.join(strata, "group").groupBy(F.col("stratum").alias("s"), F.col("resample").alias("r")).agg(F.sum("multiplicity").alias("n")).collect()} == {(s, r): n for s, n in (("a", 100), ("b", 200)) for r in range(250)}
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_from" in plan and "hashpartitioning(resample" not in plan


def test_counts_travel_in_few_bytes():
    x = np.array([[0, 0, 0], [1, 2, 255], [0, 7, 0]])
    packed = M._packed(x)
    assert packed.nbytes < 6 + 5 * 8 and (M._unpacked(packed, 3) == x).all()
    wide = M._packed(np.array([[70_000, 0, 1], [0, 0, 0]]))
    both = pa.chunked_array([packed.slice(1), wide, packed.slice(0, 0)])
    assert M._unpacked(both, 3).tolist() == [[1, 2, 255], [0, 7, 0], [70_000, 0, 1], [0, 0, 0]]
