import numpy as np
import pytest
from pyspark.sql import functions as F

from seqrisk.operators import models as L


def solve(x, y, s, c, penalised=True):
    """Newton for ½‖w‖² + C Σ s·loss with a free intercept."""
    z = np.column_stack([np.ones(len(x)), x])
    pen = np.diag([0.0] + [1.0 if penalised else 0.0] * x.shape[1])
    beta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = c * z.T @ (s * (y - p)) - pen @ beta
        step = np.linalg.solve(c * (z.T * (s * p * (1 - p))) @ z + pen, grad)
        beta += step
        if np.max(np.abs(step)) < 1e-12:
            break
    return beta


def data(seed=1, n=200, width=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(2, 3, (n, width))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 2)))).astype(int)
    return x, y


@pytest.mark.parametrize("balanced", [False, True])
@pytest.mark.parametrize("scale", [False, True])
def test_grouped_newton(spark, balanced, scale):
    rows, want = [], {}
    for g in (1, 2, 3):
        x, y = data(g)
        rows += [(g, [float(a) for a in xi], int(yi)) for xi, yi in zip(x, y)]
        s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
        m, d = (x.mean(0), x.std(0)) if scale else (0.0, np.ones(2))
        beta = solve((x - m) / d, y, s, 0.7)
        w = beta[1:] / d
        want[g] = [beta[0] - float(np.sum(w * m)), *w]
    df = spark.createDataFrame(rows, "g int, x array<double>, y_true int")
    got = {r["g"]: r["coef"] for r in L.grouped_logistic(df, ["g"], "x", 2, c=0.7, balanced=balanced, scale=scale).collect()}
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-8)


def test_separable_group_converges(spark):
    rows = [(1, [float(i)], int(i > 5)) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, x array<double>, y_true int")
    x, y = np.array([[r[1][0]] for r in rows]), np.array([r[2] for r in rows])
    got = L.grouped_logistic(df, ["g"], "x", 1, c=100.0, scale=False).first()["coef"]
    assert got == pytest.approx(list(solve(x, y, np.ones(12), 100.0)), rel=1e-6)


def test_one_class_is_an_error(spark):
    df = spark.createDataFrame([(1, [0.5], 1)], "g int, x array<double>, y_true int")
    with pytest.raises(ValueError, match="one class"):
        L.grouped_logistic(df, ["g"], "x", 1)


@pytest.mark.parametrize("cells", [L.CELLS, 0])
@pytest.mark.parametrize("balanced", [False, True])
def test_wide_logistic_matches_direct_solution(spark, balanced, cells):
    x, y = data(4, 150, 3)
    rows = [(i, i, int(yi), *map(float, xi)) for i, (xi, yi) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id long, subject_id long, y_true int, a double, b double, c double")
    got = L.fit_predict(df, df, ["a", "b", "c"], {"kind": "logreg", "C": 0.5}, 1, balanced, cells=cells)
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    z = (x - x.mean(0)) / x.std(0)
    beta = solve(z, y, s, 0.5)
    want = 1 / (1 + np.exp(-(beta[0] + z @ beta[1:])))
    risks = {r["row_id"]: r["risk"] for r in got.collect()}
    assert [risks[i] for i in range(len(y))] == pytest.approx(list(want), abs=1e-5)


def test_medians_skip_missing(spark):
    df = spark.createDataFrame([(1.0, None), (4.0, 2.0), (float("nan"), 5.0)], "a double, b double")
    assert L.column_medians(df, ["a", "b"]) == {"a": 2.5, "b": 3.5}


def test_platt_keeps_order_and_raw_rows(spark):
    rng = np.random.default_rng(3)
    rows = [("t", "tuning" if i % 2 else "held_out", 1, "m", i, i, int(rng.random() < 0.4), float(rng.random())) for i in range(300)]
    df = spark.createDataFrame(rows, "task string, split string, seed int, model string, row_id long, subject_id long, y_true int, risk double")
    out = L.platt(df).collect()
    raw = {r["row_id"]: r["risk"] for r in out if r["calibration"] == "raw"}
    new = {r["row_id"]: r["risk"] for r in out if r["calibration"] == "platt"}
    assert raw == {r[4]: r[7] for r in rows if r[1] == "held_out"} and set(new) == set(raw)
    tuning = [r for r in rows if r[1] == "tuning"]
    x = np.array([[np.log(r[7] / (1 - r[7]))] for r in tuning])
    beta = solve(x, np.array([r[6] for r in tuning]), np.ones(len(x)), 1.0)
    for k, v in raw.items():
        assert new[k] == pytest.approx(1 / (1 + np.exp(-(beta[0] + beta[1] * np.log(v / (1 - v))))), abs=1e-8)


def test_score_fusion_variants(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(200):
        y = int(rng.random() < 0.5)
        p = [float(np.clip(rng.random() * 0.7 + 0.3 * y * k, 0.01, 0.99)) for k in (1, 0.5, 0.2)]
        rows.append(("t", "tuning" if i % 2 else "held_out", 1, i, i, y, *p))
    df = spark.createDataFrame(rows, "task string, split string, seed int, row_id long, subject_id long, y_true int, p_tabular double, p_sequence double, p_numeric_sequence double")
    out = L.score_fusion(df)
    assert {r["variant"]: r["count"] for r in out.groupBy("variant").count().collect()} == {v: 100 for v in L.SCORE_VARIANTS}
    x = np.array([[np.log(r[6] / (1 - r[6])), np.log(r[7] / (1 - r[7]))] for r in rows if r[1] == "tuning"])
    beta = solve((x - x.mean(0)) / x.std(0), np.array([r[5] for r in rows if r[1] == "tuning"]), np.ones(100), 1.0)
    got = {r["row_id"]: r["risk"] for r in out.where("variant = 'fusion_tabular_sequence'").collect()}
    r = rows[0]
    z = (np.array([np.log(r[6] / (1 - r[6])), np.log(r[7] / (1 - r[7]))]) - x.mean(0)) / x.std(0)
    assert got[0] == pytest.approx(1 / (1 + np.exp(-(beta[0] + z @ beta[1:]))), abs=1e-8)


def test_names_are_checked():
    with pytest.raises(ValueError, match="nope"):
        L.select_meta_models(["rf_small", "nope"])
