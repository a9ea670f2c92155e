"""Models on feature tables.

Trees are histogram trees (``operators.trees``), wide logistic regressions take Newton's steps (``operators.newton``). The many small fits of calibration
and score fusion, one per (task, model, seed, …) on one or two scores, are solved together: every
Newton step is one grouped aggregation over all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqrisk.functions.scalars import logit, safe_float, score_transform
from seqrisk.operators.features import FEATURE_VARIANTS, PREFIXES, balanced_weights, usable_places
from seqrisk.operators.filters import union_tables
from seqrisk.operators.ranking import evaluate_predictions
from seqrisk.operators.newton import fit_logistic, spread_logistic
from seqrisk.operators.trees import BYTES, CELLS, binned_rows, bins_risk, fit_bins, fit_trees, tree_risk
from seqrisk.plans.joins import local_table, stored
from seqrisk.plans.ordered import GROUP, group_struct
from seqrisk.plans.selection import array_quantiles

# Tabular models and meta models by name.
TABULAR_MODELS = {
    "HistGradientBoosting": {"kind": "boosted", "rate": 0.05, "rounds": 200, "leaves": 31, "leaf": 20, "l2": 0.1, "balanced": True},
    "RandomForest_balanced": {"kind": "forest", "trees": 400, "depth": 12, "leaf": 10, "balanced": True},
    "LogisticRegression_balanced": {"kind": "logreg", "C": 1.0, "fill": 0.0, "balanced": True},
}
META_MODELS = {
    "lr_l2_C001": {"kind": "logreg", "C": 0.01},
    "lr_l2_C003": {"kind": "logreg", "C": 0.03},
    "lr_l2_C01": {"kind": "logreg", "C": 0.1},
    "lr_l2_C1": {"kind": "logreg", "C": 1.0},
    "histgb_small": {"kind": "boosted", "rate": 0.05, "rounds": 100, "leaves": 15, "leaf": 30, "l2": 0.1},
    "histgb_medium": {"kind": "boosted", "rate": 0.05, "rounds": 200, "leaves": 31, "leaf": 20, "l2": 0.1},
    "rf_small": {"kind": "forest", "trees": 300, "depth": 6, "leaf": 20, "fill": "median"},
}
SCORE_VARIANTS = {
    "tabular_only": ["p_tabular"],
    "sequence_only": ["p_sequence"],
    "numeric_sequence_only": ["p_numeric_sequence"],
    "fusion_tabular_sequence": ["p_tabular", "p_sequence"],
    "fusion_tabular_numeric_sequence": ["p_tabular", "p_numeric_sequence"],
}

ROW = ["row_id", "subject_id", "y_true"]
#: Small fits that are solved together at most.
MAX_FITS = 100_000


# ---------------------------------------------------------------- one large fit


#: The features of a row as one array, NULL where a number is missing.
X = "_x"


def packed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The feature columns as the array ``_x``."""
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.array(*[safe_float(c) for c in columns]).alias(X))


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of many columns; columns without a number have none."""
    found = array_quantiles(packed(df.select(*columns), columns), X, len(columns), 0.5)
    return {c: m for c, m in zip(columns, found) if m is not None}


def _numbers(values: Sequence[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def _logistic_risk(others: DataFrame, use: Sequence[int], fill: Sequence[float], start: float, factors: np.ndarray) -> DataFrame:
    """Scores as plain column expressions."""
    x = F.transform(_positions(use), lambda i: F.get(X, i))
    known = F.zip_with(x, _numbers(fill), lambda v, m: F.coalesce(v, m))
    parts = F.zip_with(known, _numbers(factors), lambda v, f: v * f)
    raw = F.aggregate(parts, F.lit(start), lambda total, v: total + v)
    keep = [c for c in others.columns if c != X]
    return others.select(*keep, (1 / (1 + F.exp(-raw))).alias("risk"))


def _positions(use: Sequence[int]) -> Column:
    return F.expr("array(" + ", ".join(map(str, use)) + ")")


def fit_predict(
    train: DataFrame,
    others: DataFrame,
    columns: Sequence[str],
    config: Mapping,
    seed: int,
    balanced: bool = False,
    fill: Mapping[str, float] | None = None,
    cells: int = CELLS,
) -> DataFrame:
    """Train on ``train`` and return ``others`` without the features but with ``risk``.

    Both carry ``row_id``, ``y_true`` and the feature columns. Trees take missing numbers as they are, unless their ``fill``
    says otherwise; elsewhere these take the training median or the fill values that are given. Forests balance the classes per tree.
    A training table of up to ``cells`` numbers is fitted inside a task, a larger one stays spread out.
    """
    columns = list(columns)
    fills = None if fill is None else [fill.get(c) for c in columns]
    return fit_packed(packed(train, columns), packed(others, columns), range(len(columns)), config, seed, balanced, fills, cells=cells)


def fit_packed(
    train: DataFrame,
    others: DataFrame,
    use: Sequence[int],
    config: Mapping,
    seed: int,
    balanced: bool = False,
    fill: Sequence[float | None] | None = None,
    n_rows: int | None = None,
    cells: int = CELLS,
) -> DataFrame:
    """``fit_predict`` on the places ``use`` of the array ``_x``; ``fill`` has a value per place that is used."""
    kind, use = config["kind"], list(use)
    if kind not in ("boosted", "forest", "logreg"):
        raise ValueError(f"Unknown model kind: {kind}")
    fills = None
    if kind == "logreg" or "fill" in config:
        if fill is None:
            medians = array_quantiles(train, X, max(use) + 1, 0.5)
            fill = [medians[i] for i in use]
        fills = [float(v or 0.0) for v in fill]
    weight = _class_weight(train) if balanced and kind != "forest" else F.lit(1.0)
    n_rows = train.count() if n_rows is None else n_rows
    if kind != "logreg":
        return tree_risk(others, X, use, fit_trees(train, X, use, config, seed, balanced, weight, fills, n_rows, cells), fills)
    fit = fit_logistic if n_rows * len(use) <= cells else spread_logistic
    found = fit(train, X, use, fills, config["C"], weight)
    return _logistic_risk(others, use, fills, *found)


def _class_weight(train: DataFrame) -> Column:
    weights = balanced_weights(train).first()
    return F.when(F.col("y_true") == 1, F.lit(weights["weight_pos"])).otherwise(F.lit(weights["weight_neg"]))


def tabular_scores(
    features: DataFrame,
    model: str | Mapping,
    seed: int,
    columns: Sequence[str],
    name: str | None = None,
) -> DataFrame:
    """Train on the train split, score tuning and held-out rows (raw probabilities)."""
    config = TABULAR_MODELS[model] if isinstance(model, str) else model
    rows = stored(
        features.withColumn("y_true", F.col("label").cast("int")).select("task", "split", *ROW, *columns)
    )
    train = rows.where(F.col("split") == "train")
    rest = rows.where(F.col("split") != "train")
    fill = {c: config["fill"] for c in columns} if "fill" in config else None
    scored = fit_predict(train, rest, columns, config, seed, config.get("balanced", False), fill)
    label = name or (model if isinstance(model, str) else config["kind"])
    return scored.select(
        "task",
        "split",
        F.lit(seed).alias("seed"),
        F.lit(label).alias("model"),
        *ROW,
        "risk",
    )


# ---------------------------------------------------------------- many small logistic fits at once


def grouped_logistic(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    size: int,
    *,
    label: str = "y_true",
    c: float = 1.0,
    balanced: bool = False,
    scale: bool = True,
    max_iter: int = 50,
    tol: float = 1e-10,
) -> DataFrame:
    """L2 logistic regression per key on array column ``x`` of ``size`` numbers.

    Minimises ½‖w‖² + C Σ s·loss with a free intercept. Each Newton step is one aggregation over the
    rows of all keys that are still moving; what comes back to the driver is one row of (size + 1)²
    sums per key, and more than ``MAX_FITS`` keys are an error. So are a NULL in ``x`` or the label, and a fit
    that does not come to rest. A NULL key is a key. Returns (keys, coef), ``coef`` being intercept first, on
    the original scale.
    """
    spark = df.sparkSession
    complete = F.col(x).isNotNull() & F.forall(x, lambda v: v.isNotNull()) & F.col(label).isNotNull()
    given = F.when(complete, F.col(x)).otherwise(F.raise_error(F.lit(f"NULL in {x} or {label}")).cast("array<double>"))
    rows = df.select(group_struct(keys).alias(GROUP), given.alias("_x"), F.col(label).cast("int").alias("_y"))
    stats_aggs = [F.avg(F.get("_x", i)).alias(f"m{i}") for i in range(size)]
    stats_aggs += [F.stddev_pop(F.get("_x", i)).alias(f"d{i}") for i in range(size)]
    stats = rows.groupBy(GROUP).agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"), *stats_aggs
    )
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        groups = {}
        found = stats.limit(MAX_FITS + 1).collect()
        if len(found) > MAX_FITS:
            raise ValueError(f"more than {MAX_FITS} fits: fit on fewer keys {list(keys)}")
        for r in found:
            if not r["pos"] or not r["neg"]:
                raise ValueError(f"only one class in group {r[GROUP].asDict()}")
            n = r["pos"] + r["neg"]
            groups[tuple(r[GROUP])] = {
                "mean": [r[f"m{i}"] if scale else 0.0 for i in range(size)],
                "dev": [(r[f"d{i}"] or 1.0) if scale else 1.0 for i in range(size)],
                "wp": n / (2 * r["pos"]) if balanced else 1.0,
                "wn": n / (2 * r["neg"]) if balanced else 1.0,
                "beta": np.zeros(size + 1),
                "last": None,
                "done": False,
                "rest": np.inf,
            }
        key_fields = [f for k in keys for f in df.select(k).schema.fields]
        numbers = T.ArrayType(T.DoubleType())
        group_field = rows.schema[GROUP]
        schema = T.StructType(
            [group_field, *[T.StructField(n, numbers) for n in ("_mean", "_dev", "_beta", "_cw")]]
        )
        names = [(i, j) for i in range(size + 1) for j in range(i, size + 1)]
        for _ in range(max_iter):
            moving = {k: g for k, g in groups.items() if not g["done"]}
            if not moving:
                break
            table = local_table(
                spark,
                [
                    (dict(zip(group_field.dataType.names, k)), list(g["mean"]), list(g["dev"]), [float(b) for b in g["beta"]], [g["wn"], g["wp"]])
                    for k, g in moving.items()
                ],
                schema,
            )
            # At most MAX_FITS short rows.
            joined = rows.join(F.broadcast(table), GROUP)
            z = [F.lit(1.0)] + [
                (F.get("_x", i) - F.get("_mean", i)) / F.get("_dev", i) for i in range(size)
            ]
            margin: Column = F.get("_beta", 0)
            for i in range(size):
                margin = margin + F.get("_beta", i + 1) * z[i + 1]
            lean = joined.select(
                GROUP,
                *[z[i].alias(f"z{i}") for i in range(size + 1)],
                F.col("_y").alias("y"),
                F.get("_cw", F.col("_y")).alias("s"),
                margin.alias("u"),
            ).withColumn("p", 1 / (1 + F.exp(-F.col("u"))))
            curve = F.col("s") * F.col("p") * (1 - F.col("p"))
            softplus = F.greatest(F.col("u"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("u")))
            sums = lean.groupBy(GROUP).agg(
                F.sum(F.col("s") * (softplus - F.col("y") * F.col("u"))).alias("loss"),
                *[F.sum(F.col("s") * (F.col("y") - F.col("p")) * F.col(f"z{i}")).alias(f"g{i}") for i in range(size + 1)],
                *[F.sum(curve * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i, j in names],
            )
            for r in sums.collect():
                g = moving[tuple(r[GROUP])]
                beta = g["beta"]
                value = c * r["loss"] + 0.5 * float(beta[1:] @ beta[1:])
                if g["last"] is not None and value > g["last"][0] + 1e-9 * abs(g["last"][0]):
                    g["beta"] = (beta + g["last"][1]) / 2  # overshoot: go half way back
                    continue
                penalty = np.diag([0.0] + [1.0] * size)
                grad = c * np.array([r[f"g{i}"] for i in range(size + 1)]) - penalty @ beta
                hess = penalty.copy()
                for i, j in names:
                    hess[i, j] += c * r[f"h{i}_{j}"]
                    hess[j, i] = hess[i, j]
                step = np.linalg.solve(hess, grad)
                g["last"] = (value, beta)
                g["beta"] = beta + step
                g["rest"] = float(np.max(np.abs(step)))
                g["done"] = g["rest"] < tol
    finally:
        rows.unpersist()
    # Rounding may keep the last steps above tol; a fit that still moves visibly has not converged.
    moving = [k for k, g in groups.items() if g["rest"] > max(tol, 1e-6)]
    if moving:
        raise ValueError(f"no convergence in {max_iter} steps for {moving[:5]}")
    found = []
    for k, g in groups.items():
        weights = [float(b) / d for b, d in zip(g["beta"][1:], g["dev"])]
        intercept = float(g["beta"][0]) - sum(w * m for w, m in zip(weights, g["mean"]))
        found.append((*k, [intercept, *weights]))
    return local_table(spark, found, T.StructType([*key_fields, T.StructField("coef", numbers)]))


def apply_logistic(df: DataFrame, coefs: DataFrame, keys: Sequence[str], x: str, size: int) -> DataFrame:
    """Add ``risk`` from fitted coefficients; the table has one row per fit, at most ``MAX_FITS``."""
    fits = coefs.select(group_struct(keys).alias(GROUP), "coef")
    joined = df.withColumn(GROUP, group_struct(keys)).join(F.broadcast(fits), GROUP)
    margin: Column = F.get("coef", 0)
    for i in range(size):
        margin = margin + F.get("coef", i + 1) * F.get(x, i)
    return joined.select(*df.columns, (1 / (1 + F.exp(-margin))).alias("risk"))


def platt(scores: DataFrame, keys: Sequence[str] = ("task", "model", "seed")) -> DataFrame:
    """Held-out predictions as they are (``raw``) and recalibrated on the tuning split (``platt``)."""
    rows = scores.withColumn("_logit", F.array(logit("risk")))
    tuning = rows.where(F.col("split") == "tuning")
    held = rows.where(F.col("split") == "held_out")
    coefs = grouped_logistic(tuning, keys, "_logit", 1, scale=False)
    plain = held.select(*keys, *ROW, F.lit("raw").alias("calibration"), "risk")
    fitted = apply_logistic(held.drop("risk"), coefs, keys, "_logit", 1)
    return plain.unionByName(fitted.select(*keys, *ROW, F.lit("platt").alias("calibration"), "risk"))


def score_fusion(
    base: DataFrame,
    transform: str = "logit",
    balanced: bool = False,
    variants: Mapping[str, Sequence[str]] = SCORE_VARIANTS,
    keys: Sequence[str] = ("task", "seed"),
) -> DataFrame:
    """Held-out risk of every score variant, fitted on tuning per task and seed.

    All (task, seed, variant) fits share their Newton steps: narrower variants are padded with a
    constant 0, whose penalised weight is 0. Ensemble scores (seed −1) are fused the same way.
    """
    by = [*keys, "variant"]
    width = max(len(cols) for cols in variants.values())
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("variant"),
                F.array(
                    *[score_transform(c, transform) for c in cols],
                    *[F.lit(0.0)] * (width - len(cols)),
                ).alias("_x"),
            )
            for name, cols in variants.items()
        ]
    )
    rows = base.select(*keys, "split", *ROW, F.inline(listed))
    tuning = rows.where(F.col("split") == "tuning")
    held = rows.where(F.col("split") == "held_out")
    coefs = grouped_logistic(tuning, by, "_x", width, balanced=balanced)
    return apply_logistic(held, coefs, by, "_x", width).drop("_x")


# ---------------------------------------------------------------- wide fusion


def _packed_features(features: DataFrame, arrays: Mapping[str, tuple[str, int]]) -> tuple[DataFrame, list[str]]:
    """Ids with all features in the array ``_x``, and the features' names: ``tab__`` columns, then the prefixed embeddings."""
    tabular = [c for c in features.columns if c.startswith(PREFIXES["tabular"])]
    names = tabular + [f"{prefix}{i:04d}" for prefix, size in arrays.values() for i in range(size)]

    def entries(name: str, size: int) -> Column:
        # Read once: the optimizer puts the array's own expression wherever an entry is asked for by its place.
        given = F.coalesce(F.col(name).cast("array<double>"), F.array().cast("array<double>"))
        return F.slice(F.concat(given, F.array_repeat(F.lit(None).cast("double"), size)), 1, size)

    spread = [entries(name, size) for name, (_, size) in arrays.items()]
    x = F.concat(F.array(*[F.col(c).cast("double") for c in tabular]), *spread) if tabular else F.concat(*spread)
    ids = [c for c in features.columns if c not in arrays and c not in tabular]
    return features.select(*ids, F.transform(x, lambda v: safe_float(v)).alias(X)), names


def _run_all(jobs: Sequence[Callable[[], DataFrame]], parallelism: int) -> DataFrame:
    """Independent fits side by side, as CrossValidator does; their outputs are appended."""
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return union_tables(*pool.map(lambda job: job(), jobs))


def meta_model_sweep(
    features: DataFrame,
    arrays: Mapping[str, tuple[str, int]],
    tasks: Sequence[str],
    seeds: Sequence[int],
    models: Mapping[str, Mapping] = META_MODELS,
    variants: Mapping[str, Sequence[str]] = FEATURE_VARIANTS,
    balanced: bool = False,
    parallelism: int | None = None,
) -> DataFrame:
    """Held-out risk of every meta model × feature variant × (task, seed), fitted on tuning.

    ``features`` has ``tab__`` columns and embedding arrays; ``arrays`` gives each array's column
    prefix and length. Usable columns, medians and the bins of trees are found once per (task, seed); trees are fitted on bins
    inside tasks up to ``BYTES`` times ``CELLS`` numbers. The longest fits come first; side by
    side run ``parallelism`` fits, at least 8 and one per core of the cluster if None.
    """
    # Many fits read parts of this table.
    wide, names = _packed_features(features, arrays)
    wide = stored(wide.select("task", "seed", "split", *ROW, X), ["task", "seed", "split"])
    trees = any(config["kind"] != "logreg" for config in models.values())

    def prepare(task: str, seed: int):
        part = wide.where((F.col("task") == task) & (F.col("seed") == seed))
        tuning = part.where(F.col("split") == "tuning")
        held = part.where(F.col("split") == "held_out")
        usable = usable_places(tuning, X)
        if held.isEmpty():
            raise ValueError(f"Missing held_out rows for task={task}, seed={seed}")
        tuning, held = tuning.select(*ROW, X), held.select(*ROW, X)
        medians, n_rows = array_quantiles(tuning, X, len(names), 0.5), tuning.count()
        bins = None
        if trees and n_rows <= CELLS and n_rows * len(usable) <= BYTES * CELLS:
            weight = _class_weight(tuning) if balanced else None
            bins = binned_rows(tuning, held, X, usable, [medians[i] or 0.0 for i in usable], weight)
        return tuning, held, usable, medians, n_rows, bins

    def fit(task, seed, ready, name, config, variant, groups) -> DataFrame:
        tuning, held, usable, medians, n_rows, bins = ready
        prefixes = tuple(PREFIXES[g] for g in groups)
        use = [i for i in usable if names[i].startswith(prefixes)]
        if not use:
            raise ValueError(f"No columns resolved for groups={list(groups)}")
        if bins and config["kind"] != "logreg":
            scored = bins_risk(bins, use, config, fit_bins(bins, use, config, seed, balanced))
        else:
            scored = fit_packed(tuning, held, use, config, seed, balanced, [medians[i] for i in use], n_rows)
        return scored.select(
            F.lit(task).alias("task"),
            F.lit(seed).alias("seed"),
            F.lit(variant).alias("variant"),
            F.lit(name).alias("meta_model"),
            F.lit(config["kind"]).alias("meta_model_kind"),
            F.lit(",".join(groups)).alias("feature_groups"),
            F.lit(sum(c.startswith(prefixes) for c in names)).alias("n_features_raw"),
            F.lit(len(use)).alias("n_features_used"),
            *ROW,
            "risk",
        )

    jobs = []
    for task, seed in product(tasks, seeds):
        ready = prepare(task, seed)
        for (name, config), (variant, groups) in product(models.items(), variants.items()):
            work = (config.get("rounds", 0) * config.get("leaves", 0), len(groups))
            jobs.append(
                (work, lambda t=task, s=seed, r=ready, n=name, c=config, v=variant, g=groups: fit(t, s, r, n, c, v, g))
            )
    jobs.sort(key=lambda job: job[0], reverse=True)
    return _run_all([job for _, job in jobs], parallelism or max(8, wide.sparkSession.sparkContext.defaultParallelism))


def embedding_fusion(
    features: DataFrame,
    arrays: Mapping[str, tuple[str, int]],
    tasks: Sequence[str],
    seeds: Sequence[int],
    c: float = 1.0,
    variants: Mapping[str, Sequence[str]] = FEATURE_VARIANTS,
    balanced: bool = False,
    parallelism: int | None = None,
) -> DataFrame:
    """Every feature variant with one logistic regression."""
    models = {"logistic_regression": {"kind": "logreg", "C": c}}
    return meta_model_sweep(features, arrays, tasks, seeds, models, variants, balanced, parallelism)


def fusion_metrics(scored: DataFrame) -> DataFrame:
    """One row per fit of ``meta_model_sweep`` or ``embedding_fusion``: its metadata and its held-out metrics."""
    fit = ["task", "seed", "variant", "feature_groups", "meta_model", "meta_model_kind", "n_features_raw", "n_features_used"]
    return evaluate_predictions(scored, fit)


def select_meta_models(names: Sequence[str]) -> dict[str, Mapping]:
    unknown = sorted(set(names) - set(META_MODELS))
    if unknown:
        raise ValueError(f"Unknown meta models: {unknown}")
    return {n: META_MODELS[n] for n in names}
