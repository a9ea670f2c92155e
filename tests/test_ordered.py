import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqrisk.plans.ordered import (
    GROUP, cut_buckets, dense_index, exact_quantiles, risk_bucket, running_sums, take_in_hash_order, value_bucket,
)


def test_buckets_never_decrease(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(2000), rng.random(500) * 1e-9, 1 - rng.random(500) * 1e-9, [0.0, 1.0, -3.0, 7.0]])
    v = np.concatenate([rng.normal(0, 1e4, 1000), rng.normal(0, 1e-4, 1000), [0.0, 1e300, -1e300]])
    for values, bucket in ((p, risk_bucket), (v, value_bucket)):
        df = spark.createDataFrame([(float(x),) for x in values], "x double")
        got = [r[0] for r in df.orderBy("x").select(bucket(F.col("x"))).collect()]
        assert got == sorted(got)


def test_quantiles_match_numpy(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([rng.gauss(0, 5), round(rng.random(), 1), None])) for k in "aabbbc" for _ in range(60)]
    rows += [("one", 4.0), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    names = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q1": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", names).collect()}
    assert set(got) == {k for k, _ in rows}
    for key, row in got.items():
        values = [v for k, v in rows if k == key and v is not None]
        for name, q in names.items():
            assert row[name] == pytest.approx(np.quantile(values, q), abs=1e-12)


@pytest.mark.parametrize("descending", [True, False])
def test_running_sums(spark, descending):
    rng = random.Random(3)
    rows = [(g, x, rng.randint(0, 5)) for g in (1, 2) for x in {round(rng.random(), 4) for _ in range(300)}]
    df = spark.createDataFrame(rows, "g int, x double, c long").select(F.struct("g").alias(GROUP), "x", "c")
    out = running_sums(df, "x", risk_bucket(F.col("x")), ["c"], descending)
    for r in out.collect():
        g = r[GROUP]["g"]
        upto = sum(c for gg, x, c in rows if gg == g and (x >= r["x"] if descending else x <= r["x"]))
        assert (r["c__upto"], r["c__all"]) == (upto, sum(c for gg, _, c in rows if gg == g))


def test_take_in_hash_order(spark):
    rows = [(g, i, (i * 7) % 4) for g in (0, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, id long, w long").select(F.struct("g").alias(GROUP), "id", "w", F.lit(101).alias("k"))
    got = {(r[GROUP]["g"], r["id"]): r["_taken"] for r in take_in_hash_order(df, "id", "k", "w").collect()}
    for g in (0, 1):
        left = 101
        for _, i, w in sorted((r for r in rows if r[0] == g), key=lambda r: (hashlib.md5(str(r[1]).encode()).hexdigest(), r[1])):
            use = max(0, min(w, left))
            left -= use
            assert got.get((g, i), 0) == use


def test_dense_index(spark):
    rows = [(g, (i * 37) % 251) for g in (0, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, u long").select(F.struct("g").alias(GROUP), "u")
    out = dense_index(df, [F.asc("u")], F.floor(F.col("u") / 10), "i").collect()
    for g in (0, 1):
        ordered = sorted(u for gg, u in rows if gg == g)
        assert {r["u"]: r["i"] for r in out if r[GROUP]["g"] == g} == {u: n for n, u in enumerate(ordered)}
    assert {r["i__n"] for r in out} == {200}


def test_close_scores_spread_over_many_buckets(spark):
    """All values within 0.001 of each other: one bucket by width, many by their quantiles, same sums."""
    rows = [(0.5 + ((i * 7919) % 5000) * 2e-7, 1 + i % 3) for i in range(5000)] + [(0.9, 5)]
    df = spark.createDataFrame(rows, "v double, c long").withColumn(GROUP, F.struct(F.lit(0).alias("_all")))
    cut = cut_buckets(df.withColumn("_bucket", risk_bucket(F.col("v"))), "v", most=100)
    sizes = [r["count"] for r in cut.groupBy("_bucket", "_sub").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 200
    for descending in (False, True):
        got = {r["v"]: (r["c__upto"], r["c__all"]) for r in running_sums(df, "v", risk_bucket(F.col("v")), ["c"], descending, most=100).collect()}
        total, want = 0, {}
        for v, c in sorted(rows, reverse=descending):
            total += c
            want[v] = total
        assert got == {v: (upto, total) for v, upto in want.items()}
