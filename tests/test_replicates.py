"""Weighted metrics of all replicates against rows that are really copied."""

import math
import random
from pathlib import Path

import numpy as np
import pytest

from seqrisk.operators import resampling as B
from seqrisk.operators.ranking import frac_limits, metric_registry, percent_limits
from seqrisk.plans import replicates as R

SCHEMA = "task string, row_id long, subject_id long, y_true int, risk_a double, risk_b double"
TOPS = [5, 10, 20]


def pairs(n, decimals, hot_score=0, seed=1):
    rng = random.Random(seed)
    out = []
    for task in ("s", "t"):
        for i in range(n):
            y = int(rng.random() < 0.3)
            a = 0.5 if i < hot_score else round(min(1.0, rng.random() * 0.7 + 0.3 * y), decimals)
            out.append((task, i, i % max(2, n // 3), y, a, round(rng.random(), decimals)))
    return out


def leaves(name, n, n_draws):
    return np.concatenate([R.leaf_weights(name, 42, n, leaf, n_draws) for leaf in range(-(-n // R.LEAF))])


def direct(rows, copies, clip, tops):
    """Metrics of (row_id, y, score) rows, each as often as ``copies`` says."""
    import hashlib

    low, high = (1e-6, 1 - 1e-6) if clip else (-math.inf, math.inf)
    made = [(min(max(s, low), high), hashlib.md5(str(i).encode()).hexdigest(), i, y) for (i, y, s), c in zip(rows, copies) for _ in range(c)]
    made.sort(key=lambda r: (-r[0], r[1], r[2]))
    y, s = np.array([r[3] for r in made]), np.array([r[0] for r in made])
    n, p = len(y), int(y.sum())
    q = np.clip(s, 1e-6, 1 - 1e-6)
    out = {"n": n, "n_positive": p, "brier": np.mean((q - y) ** 2), "logloss": -np.mean(np.where(y == 1, np.log(q), np.log(1 - q)))}
    if 0 < p < n:
        values, at = np.unique(-s, return_inverse=True)
        pos, both = np.bincount(at, y), np.bincount(at)
        cum, below = np.cumsum(pos), np.cumsum(both)
        neg = both - pos
        out["auroc"] = (neg * (cum - pos) + 0.5 * pos * neg).sum() / (p * (n - p))
        out["auprc"] = (pos * cum / below).sum() / p
    else:
        out["auroc"] = out["auprc"] = None
    for top in tops:
        k = max(1, math.ceil(n * float(top) / 100.0))
        out[f"top_{top}pct_precision"] = y[:k].sum() / k
    return out


@pytest.mark.parametrize("n", [1, 2, 1000, 1024, 1025, 5000])
def test_every_draw_has_the_size_of_the_sample(n):
    w = leaves("a", n, 300)
    assert w.shape == (n, 301) and (w[:, 0] == 1).all() and (w.sum(axis=0, dtype=int) == n).all()
    if n >= 1000:
        assert abs((w[:, 1:] == 0).mean() - math.exp(-1)) < 0.01 and abs(w[:, 1:].var() - 1) < 0.02
        assert (w[:, 1] != w[:, 2]).any() and (leaves("b", n, 300) != w).any()


@pytest.mark.parametrize("decimals,hot,cells", [(2, 0, 1 << 22), (12, 0, 600), (1, 0, 250), (2, 70, 130)])
def test_all_metrics_equal_those_of_copied_rows(spark, monkeypatch, decimals, hot, cells):
    """Ties, blocks that end inside a run of equal scores, a score that fills several blocks."""
    monkeypatch.setattr(R, "CELLS", cells)
    draws = 12
    rows = pairs(130, decimals, hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r["task"], r["draw"], r["metric"]): r for r in B.resampled_pairs(df, ["task"], "subject_id", draws, 42, limits=percent_limits(TOPS)).collect()}
    drawn = {(r["task"], r["_u"]): {d["draw"]: d["w"] for d in r["draws"]} for r in B.draw_weights(df, ["task"], "subject_id", draws, 42).select("_g.task", "_u", "draws").collect()}
    for task in ("s", "t"):
        own = [r for r in rows if r[0] == task]
        for b in range(draws + 1):
            copies = [drawn[task, r[2]].get(b, 0) for r in own]
            for side, column in (("value_a", 4), ("value_b", 5)):
                want = direct([(r[1], r[3], r[column]) for r in own], copies, True, TOPS)
                for metric in set(want) - {"n", "n_positive"}:
                    row = got[task, b, metric]
                    assert (row["n"], row["n_positive"]) == (want["n"], want["n_positive"])
                    assert row[side] == (None if want[metric] is None else pytest.approx(want[metric], abs=1e-12)), (task, b, metric)


def test_a_thousand_draws_and_the_registered_metrics(spark):
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in pairs(60, 2)]
    df = spark.createDataFrame(rows, "task string, row_id long, subject_id long, y_true int, risk double")
    got = {(r["task"], r["metric"]): r for r in B.patient_bootstrap_ci(df, ["task"], [0.05, 0.2]).collect()}
    drawn = {(r["task"], r["_u"]): {d["draw"]: d["w"] for d in r["draws"]} for r in B.draw_weights(df, ["task"], "subject_id", 1000, 42).select("_g.task", "_u", "draws").collect()}
    own = [r for r in rows if r[0] == "s"]
    found = [direct([(r[1], r[3], r[4]) for r in own], [drawn["s", r[2]].get(b, 0) for r in own], False, [5, 20]) for b in range(1001)]
    assert {m for _, m in got} == {m for m, _ in metric_registry([0.05, 0.2])}
    for metric, name in (("auroc", "auroc"), ("auprc", "auprc"), ("brier", "brier"), ("logloss", "logloss"), ("top5_precision", "top_5pct_precision"), ("top20_precision", "top_20pct_precision")):
        values = [f[name] for f in found[1:] if f[name] is not None]
        row = got["s", metric]
        assert row["observed"] == pytest.approx(found[0][name]) and row["n_bootstrap_valid"] == len(values) <= 1000
        assert row["bootstrap_mean"] == pytest.approx(np.mean(values)) and row["bootstrap_std"] == pytest.approx(np.std(values, ddof=1))
        assert (row["ci_low"], row["ci_high"]) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))


def test_null_score_is_an_error(spark):
    df = spark.createDataFrame([("s", 1, 1, 0, None, 0.5), ("s", 2, 2, 1, 0.1, 0.2)], SCHEMA)
    with pytest.raises(Exception, match="risk_a is NULL"):
        B.resampled_pairs(df, ["task"], "row_id", 3, 42, limits=frac_limits([0.1])).collect()


def test_units_drawn(spark):
    rows = [("t", 1, "b", "c", i, i % 7, i % 2, 0.1, 0.2) for i in range(20)]
    df = spark.createDataFrame(rows, "task string, seed int, baseline_variant string, candidate_variant string, row_id long, subject_id long, y_true int, risk_baseline double, risk_candidate double")
    w = leaves("t|1|b|c", 7, 30)
    got = {r["bootstrap_id"]: (r["n_subjects_sampled"], r["n_unique_subjects_sampled"]) for r in B.fusion_sample_units(df, n_draws=30).collect()}
    assert got == {b: (7, int((w[:, b] > 0).sum())) for b in range(31)}


def test_hashed_weights_follow_the_law_of_draws(spark):
    """More units than a leaf: Poisson weights of any units, corrected to exactly n draws."""
    n, draws = 5000, 403
    units = spark.range(n).selectExpr("struct('a' AS k) AS _g", "id AS _u", "id AS _i", f"{n}L AS _i__n", "'a' AS _name")
    fixed = R.corrected_units(units, draws, 42)
    w = np.empty((n, draws + 1), np.uint8)
    for r in R.unit_vectors(fixed, draws, 42).collect():
        w[r["_u"]] = np.frombuffer(r["_w"], np.uint8)
    assert (w[:, 0] == 1).all() and (w.sum(axis=0, dtype=int) == n).all()
    shares = np.bincount(w[:, 1:].ravel(), minlength=6)[:6] / (n * draws)
    assert shares == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(6)], abs=2e-3)
    between = np.corrcoef(w[:, 1:].astype(float), rowvar=False)[np.triu_indices(draws, 1)]
    assert abs(between.mean()) < 1e-3 and between.std() == pytest.approx(n**-0.5, rel=0.05)
    assert fixed.selectExpr("sum(size(_fix))").first()[0] < 2 * draws * n**0.5
    states = R._states("a", 42, np.arange(n))
    assert (R._poisson_at(states, 7) == R._poisson(states, 0, draws)[:, 7]).all()


@pytest.mark.parametrize("decimals,hot,cells", [(2, 0, 1 << 22), (12, 0, 600), (1, 70, 130)])
def test_hashed_weights_give_the_metrics_of_copied_rows(spark, monkeypatch, decimals, hot, cells):
    monkeypatch.setattr(R, "LEAF", 16)
    test_all_metrics_equal_those_of_copied_rows(spark, monkeypatch, decimals, hot, cells)


def test_what_is_written_does_not_grow_with_the_replicates(spark, monkeypatch):
    sizes, kept = [], R.stored

    def watched(df):
        out = kept(df)
        files = Path(out.stored_path.removeprefix("file:")).glob("*.parquet")
        sizes.append(sum(f.stat().st_size for f in files))
        return out

    monkeypatch.setattr(R, "stored", watched)
    df = spark.createDataFrame(pairs(3000, 3), SCHEMA)
    B.resampled_pairs(df, ["task"], "row_id", 1000, 42, limits=percent_limits(TOPS))
    assert sizes[0] < 12000 * 100  # blocks of 12000 scores; a byte per weight would be 12 MB


@pytest.mark.parametrize("n", [700, 5000])
def test_weights_by_rows_are_those_by_replicates(n):
    draws, rng = 403, np.random.default_rng(3)
    units = rng.integers(0, n, 900)
    fix_at = np.concatenate([[0], np.cumsum(rng.integers(0, 3, 900))]).astype(np.int32)
    fixes = (2 * rng.integers(0, draws, fix_at[-1]) + 1).astype(np.int32)
    want = np.empty((900, draws + 1), np.uint8)
    for part, w in R.weight_columns("a", 42, n, draws, units, fix_at, fixes):
        want[:, part] = w
    got = np.concatenate([w for _, w in R.weight_rows("a", 42, n, draws, units, fix_at, fixes)])
    assert (got == want[:, 1:]).all()


def test_only_blocks_that_a_limit_or_an_inner_run_needs_are_read_again(spark, monkeypatch):
    """Two scores fill 64 blocks; only those at a limit are evaluated row by row, and the metrics are those of copied rows."""
    draws = 12
    monkeypatch.setattr(R, "CELLS", 50 * (draws + 1))
    opened, kept = [], R._opened

    def watched(*args):
        opened.append(kept(*args))
        return opened[-1]

    monkeypatch.setattr(R, "_opened", watched)
    rows = [("s", i, i % 400, int(i % 3 == 0), 0.75 if i % 2 else 0.25) for i in range(3200)]
    df = spark.createDataFrame(rows, "task string, row_id long, subject_id long, y_true int, risk double")
    got = {r["metric"]: r for r in B.patient_bootstrap_ci(df, ["task"], [0.05, 0.2], n_draws=draws).collect()}
    assert opened[0].where("seq is not null").count() <= 16
    drawn = {r["_u"]: {d["draw"]: d["w"] for d in r["draws"]} for r in B.draw_weights(df, ["task"], "subject_id", draws, 42).select("_u", "draws").collect()}
    found = [direct([(r[1], r[3], r[4]) for r in rows], [drawn[r[2]].get(b, 0) for r in rows], False, [5, 20]) for b in range(draws + 1)]
    for metric, name in (("auroc", "auroc"), ("auprc", "auprc"), ("brier", "brier"), ("logloss", "logloss"), ("top5_precision", "top_5pct_precision"), ("top20_precision", "top_20pct_precision")):
        assert got[metric]["observed"] == pytest.approx(found[0][name], abs=1e-12)
        assert got[metric]["bootstrap_mean"] == pytest.approx(np.mean([f[name] for f in found[1:]]), abs=1e-12)


def test_equal_hashes_are_told_apart_by_their_second_half():
    hashes = np.array([[5, 2], [5, 1], [4, 9], [5, 0], [1, 1]], np.uint64)
    assert R._in_order(np.array([1, 1, 1, 1, 0]), np.array([0.5, 0.5, 0.5, 0.7, 0.1]), hashes).tolist() == [4, 3, 2, 1, 0]
    assert R._in_order(np.zeros(3, int), np.array([0.1, 0.3, 0.3]), np.array([[1, 0], [9, 0], [2, 0]], np.uint64)).tolist() == [2, 1, 0]
