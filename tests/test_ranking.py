import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from seqrisk.operators import ranking as M

SCHEMA = "g string, row_id long, y_true int, risk double, w long"
FRACS = [0.01, 0.05, 0.1, 0.2]


def sample(seed, n=300, levels=15, g="g"):
    rng = random.Random(seed)
    return [(g, i, int(rng.random() < 0.3), rng.randint(0, levels) / levels, rng.randint(0, 3)) for i in range(n)]


def brute(rows, weighted=False, clip=False):
    copies = [(min(max(r[3], 1e-6), 1 - 1e-6) if clip else r[3], r[2], r[1]) for r in rows for _ in range(r[4] if weighted else 1)]
    pos, neg = [c for c in copies if c[1]], [c for c in copies if not c[1]]
    auc = sum((p[0] > q[0]) + 0.5 * (p[0] == q[0]) for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None
    ap = None
    if pos and neg:
        ap = 0.0
        for s in sorted({c[0] for c in copies}, reverse=True):
            above = [c for c in copies if c[0] >= s]
            ap += sum(c[1] for c in copies if c[0] == s) * sum(c[1] for c in above) / len(above)
        ap /= len(pos)
    q = [(min(max(c[0], 1e-6), 1 - 1e-6), c[1]) for c in copies]
    ordered = sorted(copies, key=lambda c: (-c[0], hashlib.md5(str(c[2]).encode()).hexdigest(), c[2]))
    tops = []
    for f in FRACS:
        k = max(1, math.ceil(len(copies) * f))
        tops.append((k, sum(c[1] for c in ordered[:k])))
    n = len(copies)
    return {
        "n": n, "n_positive": len(pos), "auroc": auc, "auprc": ap, "brier": sum((a - y) ** 2 for a, y in q) / n,
        "logloss": -sum(math.log(a if y else 1 - a) for a, y in q) / n, "tops": tops,
    }


def check(row, want):
    for name, value in want.items():
        if name == "tops":
            assert [(row[f"k_{i}"], row[f"events_{i}"]) for i in range(len(FRACS))] == value
        elif value is None:
            assert row[name] is None
        else:
            assert row[name] == pytest.approx(value, abs=1e-10), name


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("levels", [1, 15, 10_000])
def test_against_brute_force(spark, weighted, levels):
    rows = sample(1, levels=levels) + [("one_class", i, 1, 0.5, 1) for i in range(7)] + [(None, i, i % 2, 0.1 * i, 2) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["g"]: r for r in M.ranking_frame(df, ["g"], M.frac_limits(FRACS), weight="w" if weighted else None).collect()}
    assert set(got) == {"g", "one_class", None}
    for key, row in got.items():
        check(row, brute([r for r in rows if r[0] == key], weighted))


def test_clip_makes_ties(spark):
    rows = [("g", i, y, p, 1) for i, (y, p) in enumerate([(1, 0.0), (0, 1e-8), (1, 1.0), (0, 1 - 1e-9), (0, 0.5)])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert M.auroc(df, ["g"]).first()["auroc"] == pytest.approx(brute(rows)["auroc"])
    assert M.auroc(df, ["g"], clip=True).first()["auroc"] == pytest.approx(brute(rows, clip=True)["auroc"])


def test_complement(spark):
    df = spark.createDataFrame(sample(4), SCHEMA)
    a = M.auroc(df, ["g"]).first()["auroc"]
    b = M.auroc(df.withColumn("risk", 1 - F.col("risk")), ["g"]).first()["auroc"]
    assert a + b == pytest.approx(1.0)


def test_average_precision_is_not_the_trapezoid(spark):
    rows = [("g", i, y, p, 1) for i, (y, p) in enumerate([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (1, 0.5)])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert M.auprc(df, ["g"]).first()["auprc"] == pytest.approx(0.755555, abs=1e-5)


def test_names(spark):
    df = spark.createDataFrame(sample(5), SCHEMA)
    want = brute([r for r in sample(5)], clip=True)
    assert M.metric_by_name(df, ["g"], "auprc").first()["value"] == pytest.approx(want["auprc"])
    k, events = want["tops"][2]
    assert M.metric_by_name(df, ["g"], "top_10pct_precision").first()["value"] == pytest.approx(events / k)
    with pytest.raises(ValueError):
        M.metric_by_name(df, ["g"], "f1")
    assert dict(M.metric_registry([0.05]))["brier"] is False and len(M.metric_registry([0.05, 0.1])) == 10


def test_base_rate_zero(spark):
    df = spark.createDataFrame([("g", i, 0, 0.1 * i, 1) for i in range(5)], SCHEMA)
    row = M.topk_stats(df, ["g"], 0.2).first()
    assert row["precision"] == 0 and row["lift"] is None and row["event_capture"] is None


def test_null_risk_is_an_error(spark):
    df = spark.createDataFrame([("g", 1, 0, None, 1)], SCHEMA)
    with pytest.raises(Exception, match="risk is NULL"):
        M.auroc(df, ["g"]).collect()


def test_one_score_for_almost_all_rows(spark):
    """A single score shared by most rows, cut by every limit."""
    rows = [("g", i, i % 3 == 0, 0.5 if i % 10 else i / 5000, 1) for i in range(5000)]
    rows = [(g, i, int(y), p, w) for g, i, y, p, w in rows]
    got = M.ranking_frame(spark.createDataFrame(rows, SCHEMA), ["g"], M.frac_limits(FRACS)).first()
    ordered = sorted(rows, key=lambda r: (-r[3], hashlib.md5(str(r[1]).encode()).hexdigest(), r[1]))
    for i, f in enumerate(FRACS):
        k = math.ceil(5000 * f)
        assert (got[f"k_{i}"], got[f"events_{i}"]) == (k, sum(r[2] for r in ordered[:k]))
