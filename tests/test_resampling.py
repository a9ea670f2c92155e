import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqrisk.operators import joins as J
from seqrisk.operators import resampling as B
from seqrisk.plans.ordered import ungroup

SCHEMA = "task string, row_id long, subject_id long, y_true int, risk_a double, risk_b double"


def pairs(seed=1, n=120, hot=0):
    """Subjects with one to a few rows; ``hot`` rows belong to one subject."""
    rng = random.Random(seed)
    out = []
    for t in ("s", "t"):
        for i in range(n):
            subject = 1000 if i < hot else rng.randint(0, 25)
            y = int(rng.random() < 0.4)
            out.append((t, i, subject, y, round(rng.random() * 0.6 + 0.3 * y, 2), round(rng.random(), 2)))
    return out


def weights(spark, rows, unit, n_draws=15):
    df = spark.createDataFrame(rows, SCHEMA)
    out = ungroup(B.draw_weights(df, ["task"], unit, n_draws, 42), ["task"])
    got = defaultdict(dict)
    for r in out.select("task", "_u", F.inline("draws")).collect():
        got[(r["task"], r["draw"])][r["_u"]] = r["w"]
    return got


@pytest.mark.parametrize("unit,column", [("row_id", 1), ("subject_id", 2)])
def test_every_draw_has_the_size_of_the_sample(spark, unit, column):
    rows = pairs()
    got = weights(spark, rows, unit)
    for t in ("s", "t"):
        units = {r[column] for r in rows if r[0] == t}
        assert got[(t, 0)] == {u: 1 for u in units}
        for b in range(1, 16):
            assert sum(got[(t, b)].values()) == len(units) and set(got[(t, b)]) <= units
    assert got[("s", 1)] != got[("s", 2)] != got[("t", 2)]


def brier(rows, col):
    return float(np.mean([(min(max(r[col], 1e-6), 1 - 1e-6) - r[3]) ** 2 for r in rows]))


@pytest.mark.parametrize("hot", [0, 80])
def test_cluster_delta_equals_copied_rows(spark, hot):
    """Metrics on weighted rows equal metrics on rows that are really copied."""
    rows = pairs(3, hot=hot)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["task"], r["metric"]): r for r in B.cluster_delta(df, ["task"], n_draws=15).collect()}
    drawn = weights(spark, rows, "subject_id")
    for t in ("s", "t"):
        mine = [r for r in rows if r[0] == t]
        deltas = []
        for b in range(1, 16):
            copies = [r for r in mine for _ in range(drawn[(t, b)].get(r[2], 0))]
            deltas.append(brier(copies, 4) - brier(copies, 5))
        row = got[(t, "brier")]
        assert row["point_delta_a_minus_b"] == pytest.approx(brier(mine, 4) - brier(mine, 5))
        assert row["bootstrap_mean_delta"] == pytest.approx(np.mean(deltas))
        assert row["bootstrap_std_delta"] == pytest.approx(np.std(deltas, ddof=1))
        assert (row["ci_low"], row["ci_high"]) == pytest.approx(tuple(np.quantile(deltas, [0.025, 0.975])))
        assert row["n_paired_patients"] == len({r[2] for r in mine}) and row["n_bootstrap_valid"] == 15


def test_single_class_draws_are_left_out(spark):
    rows = [("t", i, i, int(i == 0), 0.1 * i, 0.05 * i) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["metric"]: r for r in B.paired_delta(df, ["task"], n_draws=30).collect()}
    assert 0 < got["auroc"]["n_bootstrap_valid"] < 30 == got["brier"]["n_bootstrap_valid"]


def test_fusion_signs_and_shares(spark):
    rng = random.Random(5)
    rows = []
    for i in range(150):
        y = int(rng.random() < 0.4)
        for v, s in (("base", 0.1), ("cand", 0.5)):
            rows.append(("t", 1, v, i, i % 30, y, min(0.99, rng.random() * 0.5 + s * y)))
    pred = spark.createDataFrame(rows, "task string, seed int, variant string, row_id long, subject_id long, y_true int, risk double")
    paired = J.paired_variants(pred, [("base", "cand")], ["task", "seed", "row_id", "subject_id", "y_true"])
    samples = B.fusion_samples(paired, n_draws=20)
    out = {r["metric"]: r for r in B.fusion_summary(samples, paired, 20).collect()}
    for m, r in out.items():
        assert 0 <= r["prob_improvement"] <= 1 and 0 <= r["p_two_sided_improvement"] <= 1
        sign = -1 if m in ("brier", "logloss") else 1
        assert r["improvement_observed"] == pytest.approx(sign * r["delta_candidate_minus_baseline_observed"])
    assert out["auroc"]["improvement_observed"] > 0 and out["auroc"]["n_subjects"] == 30


def test_pairwise_rejects_unknown_keys(spark):
    config = [{"key": "a", "task": "t", "family": "f", "version": "v", "model": "m"}]
    pair = [{"comparison": "c", "description": "", "task": "t", "a": "a", "b": "zzz"}]
    with pytest.raises(ValueError, match="zzz"):
        B.pairwise_comparisons(spark.range(1), config, pair)
    with pytest.raises(ValueError, match="Duplicate"):
        B.pairwise_comparisons(spark.range(1), config * 2, pair)


def test_summary_of_one_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", None)], "k string, value double")
    got = {r["k"]: r for r in B.summarize_draws(df, ["k"]).collect()}
    assert (got["a"]["std"], got["a"]["n_valid"], got["c"]["n_valid"], got["c"]["mean"]) == (0.0, 1, 0, None)
    assert B.summarize_draws(df, ["k"], lone_std=None).where("k = 'a'").first()["std"] is None
