"""Trees against a slow version in plain Python, and spread rows against rows in one task."""

import math

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from seqrisk.operators import models as L
from seqrisk.operators import trees as T
from seqrisk.plans.replicates import LEAF, leaf_weights
from seqrisk.plans.selection import array_quantiles

BOOSTED = {"kind": "boosted", "rate": 0.1, "rounds": 12, "leaves": 6, "leaf": 5, "l2": 0.1}
FOREST = {"kind": "forest", "trees": 20, "depth": 4, "leaf": 3}
COLUMNS = ["a", "b", "c", "d", "e"]


def data(n=160, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), rng.normal(size=n) ** 3, np.full(n, 2.0), rng.integers(0, 2, n)]).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] + x[:, 1] - 2)))).astype(int)
    x[rng.random(x.shape) < 0.15] = np.nan
    return x, y


def frame(spark, x, y):
    rows = [(i, int(y[i]), *[None if i % 2 and math.isnan(v) else float(v) for v in x[i]]) for i in range(len(y))]
    return spark.createDataFrame(rows, "row_id long, y_true int, " + ", ".join(f"{c} double" for c in COLUMNS)).repartition(4)


def candidates(x, rows, j):
    """Cuts between neighbouring distinct values of the whole training column, and one that only missing values pass."""
    known = sorted(set(v for v in x[:, j] if not math.isnan(v)))
    return [(a + b) / 2 for a, b in zip(known, known[1:])] + [math.inf]


def slow_split(x, rows, g, h, leaf, l2, least, features):
    """Best (gain, feature, cut, missing left) of a node, by trying all."""
    def part(some):
        return sum(g[i] for i in some), sum(h[i] for i in some)

    whole = part(rows)
    best = None
    for j in features:
        gaps = [i for i in rows if math.isnan(x[i, j])]
        for missing_left in (False, True) if gaps else (False,):
            for cut in candidates(x, rows, j):
                low = [i for i in rows if x[i, j] <= cut] + (gaps if missing_left else [])
                high = [i for i in rows if x[i, j] > cut] + ([] if missing_left else gaps)
                (gl, hl), (gr, hr) = part(low), part(high)
                if min(len(low), len(high)) < leaf or min(hl, hr) < least:
                    continue
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - whole[0] ** 2 / (whole[1] + l2)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-8):
                    best = (gain, j, cut, missing_left if gaps else len(low) > len(high), low, high)
    return best


def walk(node, row):
    while "cut" in node:
        v = row[node["feature"]]
        left = node["gap"] if math.isnan(v) else v <= node["cut"]
        node = node["left" if left else "right"]
    return node["value"]


def slow_boost(x, y, w, config):
    start = math.log(w[y == 1].sum() / w[y == 0].sum())
    raw, trees = np.full(len(y), start), []
    for _ in range(config["rounds"]):
        p = 1 / (1 + np.exp(-raw))
        g, h = (p - y) * w, p * (1 - p) * w

        def leaf_of(rows, g=g, h=h):
            value = -config["rate"] * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + config["l2"])
            return {"value": value, "split": slow_split(x, rows, g, h, config["leaf"], config["l2"], 1e-3, range(x.shape[1]))}

        root = leaf_of(list(range(len(y))))
        open_leaves, n = [root], 1
        while n < config["leaves"]:
            able = [o for o in open_leaves if o["split"]]
            if not able:
                break
            top = max(able, key=lambda o: o["split"][0])
            _, top["feature"], top["cut"], top["gap"], low, high = top["split"]
            top["left"], top["right"] = leaf_of(low), leaf_of(high)
            open_leaves = [o for o in open_leaves if o is not top] + [top["left"], top["right"]]
            n += 1
        trees.append(root)
        raw = raw + np.array([walk(root, row) for row in x])
    return lambda rows: 1 / (1 + np.exp(-(start + np.array([sum(walk(t, r) for t in trees) for r in rows]))))


def test_boosting_equals_the_slow_version():
    x, y = data()
    w = np.where(y == 1, 1.4, 0.8)
    cuts = [T.cuts_of(x[:, j]) for j in range(x.shape[1])]
    start, trees = T.boost(T.bin_values(x, cuts), y, w, BOOSTED)
    assert all(len(t.feature) == 2 * BOOSTED["leaves"] - 1 for t in trees)
    fresh, _ = data(60, 9)
    both = np.vstack([x, fresh])
    assert T.Model(cuts, trees, start).risk(both) == pytest.approx(slow_boost(x, y, w, BOOSTED)(both), abs=1e-9)


def test_forest_equals_the_slow_version():
    x, y = data(90, 4)
    n, width = x.shape
    cuts = [T.cuts_of(x[:, j]) for j in range(width)]
    found = T.forest(T.bin_values(x, cuts), y, FOREST, 7, True, 3, 8)
    drawn = np.concatenate([leaf_weights("forest", 7, n, k, FOREST["trees"]) for k in range(-(-n // LEAF))])
    many = int(math.sqrt(width))
    for t, tree in zip(range(3, 8), found):
        m = drawn[:, t + 1].astype(float)
        assert m.sum() == n
        sides = [n / (2 * m[y == k].sum()) for k in (0, 1)]
        w = m * np.where(y == 1, sides[1], sides[0])
        number = {"next": 1}

        def level(root_rows, w=w, t=t, number=number):
            root = {"rows": root_rows, "n": 0, "depth": 0}
            waiting = [root]
            while waiting:
                node = waiting.pop(0)
                node["value"] = sum(w[i] * y[i] for i in node["rows"]) / sum(w[i] for i in node["rows"])
                if node["depth"] == FOREST["depth"]:
                    continue
                features = sorted(np.random.default_rng([7, t, node["n"]]).permutation(width)[:many])
                split = slow_split(x, node["rows"], w * y, w, FOREST["leaf"], 0.0, 1e-12, features)
                if split:
                    _, node["feature"], node["cut"], node["gap"], low, high = split
                    for side, rows in (("left", low), ("right", high)):
                        node[side] = {"rows": rows, "n": number["next"], "depth": node["depth"] + 1}
                        number["next"] += 1
                        waiting.append(node[side])
            return root

        root = level([i for i in range(n) if m[i]])
        assert tree.values(T.bin_values(x, cuts)) == pytest.approx([walk(root, r) for r in x], abs=1e-12)


@pytest.mark.parametrize("config", [{**BOOSTED, "rounds": 5}, {**FOREST, "trees": 9}, {**BOOSTED, "leaves": 2, "rounds": 3}])
def test_spread_rows_give_the_same_model(spark, monkeypatch, config):
    x, y = data(120, 2)
    df, use = L.packed(frame(spark, x, y), COLUMNS), range(len(COLUMNS))
    weight = F.when(F.col("y_true") == 1, 1.5).otherwise(1.0)
    own = T.fit_trees(df, L.X, use, config, 3, True, weight)
    monkeypatch.setattr(T, "STEP", 12)
    monkeypatch.setattr(T, "AGAIN", 2)
    far = T.fit_trees(df, L.X, use, config, 3, True, weight, cells=0)
    assert [t.feature for t in far.trees] == [t.feature for t in own.trees]
    assert far.risk(x) == pytest.approx(own.risk(x), abs=1e-9)
    got = {r["row_id"]: r["risk"] for r in T.tree_risk(df, L.X, use, far).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(own.risk(x), abs=1e-9)


def test_many_distinct_values_are_cut_at_quantiles(spark):
    v = np.random.default_rng(1).normal(size=5000)
    near, far = T.cuts_of(v), T.spread_cuts(spark.createDataFrame([([float(a), 1.0],) for a in v], "x array<double>"), "x", [0, 1])
    assert len(near) == 254 and len(far[0]) <= 254 and len(far[1]) == 0
    filled = np.bincount(np.searchsorted(far[0], v, "left"))
    assert filled.max() < 3 * 5000 / 255


def test_one_class_and_no_split(spark):
    x, y = data(30)
    with pytest.raises(Exception, match="one class"):
        T.fit_trees(L.packed(frame(spark, x, np.zeros(30, int)), COLUMNS), L.X, range(5), BOOSTED, 1)
    for cells in (T.CELLS, 0):
        model = T.fit_trees(L.packed(frame(spark, x, y), COLUMNS), L.X, range(5), {**BOOSTED, "leaf": 20}, 1, cells=cells)
        assert model.risk(x) == pytest.approx(np.full(30, y.mean()))


@pytest.mark.parametrize("kind", ["logreg", "boosted", "forest"])
def test_fits_survive_an_observed_action(spark, kind):
    """An observation leaves a manager in the session that must not travel with a fitted model."""
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    x, y = data(80)
    config = {"logreg": {"kind": "logreg", "C": 1.0}, "boosted": BOOSTED, "forest": FOREST}[kind]
    rows = L.fit_predict(frame(spark, x, y), frame(spark, x, y), COLUMNS, config, 1, True).collect()
    assert len(rows) == 80 and all(0 < r["risk"] < 1 or kind == "forest" for r in rows)


def test_column_medians(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(101, 4)) * np.array([1.0, 1e-300, 1e300, 1.0])
    x[:, 3] = np.round(x[:, 3])
    x[rng.random(x.shape) < 0.3] = np.nan
    x[0, 0], x[1, 0], x[:2, 3] = -0.0, 0.0, -0.0
    rows = [([None if math.isnan(v) and i % 2 else float(v) for v in r] + [None, 1.5 if i == 3 else None],) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "x array<double>").repartition(3)
    for q in (0.5, 0.0, 0.3, 1.0):
        *got, none, one = array_quantiles(df, "x", 6, q)
        assert got == pytest.approx([np.nanquantile(x[:, j], q) for j in range(4)], rel=1e-12) and none is None and one == 1.5
    assert array_quantiles(df.where("false"), "x", 2, 0.5) == [None, None]


@pytest.mark.parametrize("kept", [T.KEPT, 0])
def test_larger_children_are_not_counted_again(monkeypatch, kept):
    """Of two children the rows of the smaller are counted; the trees are those of counting all."""
    x, y = data(400, 6)
    x = np.nan_to_num(x)
    bins = T.bin_values(x, [T.cuts_of(x[:, j]) for j in range(x.shape[1])])
    seen, count = [], T.sums_of_counted

    def counted(columns, features, at, g, h):
        seen.append(len(at))
        found = count(columns, features, at, g, h)
        assert found == pytest.approx(T.sums_of(columns[np.ix_(features, at)].T, g[at], h[at], np.ones(len(at))), abs=1e-12)
        return found

    monkeypatch.setattr(T, "sums_of_counted", counted)
    monkeypatch.setattr(T, "KEPT", kept)
    monkeypatch.setattr(T, "SHORT", 50)
    _, trees = T.boost(bins, y, np.ones(len(y)), BOOSTED)
    assert sum(seen) < (2.4 if kept else 6) * len(y) * len(trees)
    if kept:
        assert all(n <= len(y) / 2 or n == len(y) for n in seen)
        monkeypatch.setattr(T, "KEPT", 0)
        _, others = T.boost(bins, y, np.ones(len(y)), BOOSTED)
        assert [t.feature for t in trees] == [t.feature for t in others] and [t.bin for t in trees] == [t.bin for t in others]


@pytest.mark.parametrize("config", [BOOSTED, {**FOREST, "fill": "median"}])
def test_bins_made_once_give_the_same_model(spark, config):
    """A fit on some places of a table that was binned once is the fit on those places."""
    x, y = data(150, 8)
    fresh, z = data(70, 9)
    train, others = (L.packed(frame(spark, *both), COLUMNS) for both in ((x, y), (fresh, z)))
    weight = F.when(F.col("y_true") == 1, 1.5).otherwise(1.0)
    medians = np.nanmedian(x, axis=0)
    table = T.binned_rows(train, others, L.X, [0, 1, 2, 4], medians[[0, 1, 2, 4]], weight)
    assert all(len(r["bins"]) == len(r["filled"]) == 4 for r in table.train.collect())
    for use in ([0, 1, 2, 4], [1, 4]):
        fills = medians[use].tolist() if "fill" in config else None
        own = T.fit_trees(train, L.X, use, config, 3, True, weight, fills)
        want = {r["row_id"]: r["risk"] for r in T.tree_risk(others, L.X, use, own, fills).collect()}
        model = T.fit_bins(table, use, config, 3, True)
        assert [vars(t) for t in model.trees] == [vars(t) for t in own.trees]
        assert {r["row_id"]: r["risk"] for r in T.bins_risk(table, use, config, model).collect()} == want


def test_a_sweep_beyond_the_numbers_of_a_task_fits_its_trees_on_bins(spark, monkeypatch):
    """More numbers than ``CELLS``, fewer than as many bytes: no tree is grown over spread rows, and the scores stay the same."""
    rng = np.random.default_rng(2)
    rows = [("v", s, k % 4 == 0 and "held_out" or "tuning", k, k % 9, int(rng.random() < 0.4), float(k % 5), [float(v) for v in rng.normal(size=3)]) for s in (1, 2) for k in range(160)]
    df = spark.createDataFrame(rows, "task string, seed int, split string, row_id long, subject_id long, y_true int, tab__0000 double, emb array<double>")
    models = {"b": {**BOOSTED, "rounds": 4}, "f": {**FOREST, "trees": 5, "fill": "median"}, "l": {"kind": "logreg", "C": 1.0}}
    variants = {"both": ["tabular", "sequence_embedding"], "tab": ["tabular"]}

    def scores():
        out = L.meta_model_sweep(df, {"emb": ("seq_emb__", 3)}, ["v"], [1, 2], models, variants)
        return {(r["seed"], r["variant"], r["meta_model"], r["row_id"]): r["risk"] for r in out.collect()}

    want = scores()
    assert len(want) == 2 * 3 * 2 * 40

    def spread(*args):
        raise AssertionError("rows are spread")

    monkeypatch.setattr(T, "SpreadRows", spread)
    monkeypatch.setattr(L, "CELLS", 200)
    monkeypatch.setattr(T.fit_trees, "__defaults__", (*T.fit_trees.__defaults__[:-1], 200))
    monkeypatch.setattr(L.fit_packed, "__defaults__", (*L.fit_packed.__defaults__[:-1], 200))
    got = scores()
    assert got.keys() == want.keys() and list(got.values()) == pytest.approx([want[k] for k in got], abs=1e-9)


def test_entries_of_short_and_missing_arrays_are_missing(spark):
    rows = [(1, 0.5, [1.0, float("nan"), 3.0, 4.0]), (2, None, [5.0]), (3, 1.5, None)]
    df = spark.createDataFrame(rows, "row_id long, tab__0000 double, emb array<double>")
    doubled = df.withColumn("emb", F.transform("emb", lambda v: v * 2))
    out, names = L._packed_features(doubled, {"emb": ("e__", 3)})
    assert names == ["tab__0000", "e__0000", "e__0001", "e__0002"]
    assert {r["row_id"]: r[L.X] for r in out.collect()} == {1: [0.5, 2.0, None, 6.0], 2: [None, 10.0, None, None], 3: [1.5, None, None, None]}
    # The doubling is not put inside a function of an entry's place.
    assert ")[lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
