"""Paired bootstrap over rows or subjects, for any number of comparisons at once.

A draw gives each unit an integer weight instead of copying rows: n draws with replacement from the n units of a
comparison, repeatable on any cluster. A row meets its unit's number in one join and is ordered once; the tasks that hold
the ordered rows make the weights and evaluate the metrics of all replicates together (``plans.replicates``).
Replicate 0 is the observed data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrisk.functions.scalars import EPS, clip_prob, subgroup_label
from seqrisk.operators.joins import paired_variants, require_rows
from seqrisk.operators.ranking import (
    BASE_METRICS,
    LOWER_IS_BETTER,
    Limit,
    evaluated_metrics,
    frac_limits,
    percent_limits,
    registered_metrics,
    unpivot_metrics,
)
from seqrisk.plans.joins import local_table, lookup_join, stored
from seqrisk.plans.ordered import GROUP, dense_index, group_struct, hash_text, never_null
from seqrisk.plans.replicates import corrected_units, drawn_units, replicate_metrics, unit_vectors
from seqrisk.schemas import ENSEMBLE_SEED, default_columns

PAIR_METRICS = BASE_METRICS + ["top_5pct_precision", "top_10pct_precision", "top_20pct_precision"]
PERCENTS = [5, 10, 20]


def _key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(GROUP)[k].cast("string") for k in keys]) if keys else F.lit("")


def _units(df: DataFrame, keys: Sequence[str], unit: str, names: DataFrame | None = None) -> DataFrame:
    """(_g, _u, _i, _i__n, _name): the units of each comparison, numbered in hash order.

    The text that seeds a comparison is its keys, or the ``_name`` that ``names`` (one row per comparison) gives its number.
    """
    units = df.select(group_struct(keys).alias(GROUP), F.col(unit).alias("_u")).distinct()
    place = hash_text(F.col("_u"))
    indexed = dense_index(
        units, [F.col("_u")], never_null(F.substring(place, 1, 3), F.lit("")), "_i"
    )
    if names is None:
        return indexed.select(GROUP, "_u", "_i", "_i__n", _key_text(keys).alias("_name"))
    return lookup_join(indexed.select(GROUP, "_u", "_i", "_i__n"), names, [GROUP], at_hand=True)


def draw_weights(
    df: DataFrame,
    keys: Sequence[str],
    unit: str,
    n_draws: int,
    seed: int,
) -> DataFrame:
    """(_g, unit, draws): how often each unit of a comparison is drawn in each replicate.

    ``draws`` is array<struct<draw, w>> without the replicates that leave the unit out, and starts with replicate 0, weight 1.
    """
    vectors = unit_vectors(corrected_units(stored(_units(df, keys, unit)), n_draws, seed), n_draws, seed)
    digits = F.transform(F.sequence(F.lit(0), F.lit(n_draws)), lambda b: F.struct(
        b.alias("draw"), F.conv(F.substring(F.hex("_w"), 2 * b + 1, 2), 16, 10).cast("long").alias("w")
    ))
    return vectors.select(GROUP, "_u", F.filter(digits, lambda d: d["w"] > 0).alias("draws"))


def _numbered(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a number ``_k`` in place of their keys, table of the keys by number).

    Every weighted row and every score count carries its comparison through a shuffle; a number is a
    few bytes where the keys are several names. Both tables are stored, because units, draws and two
    passes of the metrics read them.
    """
    held = [c for c in df.columns if c not in keys]
    rows = df.select(*held, group_struct(keys).alias("_keys"))
    listed = rows.select("_keys").distinct().withColumn(GROUP, group_struct([]))
    table = stored(
        dense_index(listed, [F.asc("_keys")], F.lit(0), "_k").select(
            "_keys", F.col("_k").cast("int").alias("_k")
        )
    )
    return stored(lookup_join(rows, table, ["_keys"], at_hand=True).drop("_keys")), table


def _renamed(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key columns back in place of the number."""
    rest = [c for c in df.columns if c != "_k"]
    joined = lookup_join(df, table, ["_k"], at_hand=True)
    return joined.select(*[F.col("_keys")[k].alias(k) for k in keys], *rest)


def _drawable(rows: DataFrame, table: DataFrame, keys: Sequence[str], unit: str, n_draws: int, seed: int) -> DataFrame:
    """(_g, _u, _i, _i__n, _name, _fix), stored: the units of the numbered comparisons and what their weights are made from."""
    names = table.select(
        F.struct("_k").alias(GROUP),
        F.concat_ws("|", *[F.col("_keys")[k].cast("string") for k in keys]).alias("_name"),
    )
    return stored(corrected_units(stored(_units(rows, ["_k"], unit, names)), n_draws, seed))


def _replicates(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    unit: str,
    n_draws: int,
    seed: int,
    scores: Sequence[str],
    limits: Sequence[Limit] | None,
    fracs: Sequence[float] | None,
) -> tuple[DataFrame, list[str]]:
    """Per comparison, side (the place in ``scores``) and replicate: every metric, and the metrics' names.

    On clipped scores when limits are named in percent. A row meets its unit's number once, by a merge that
    adaptive execution splits where a unit is hot.
    """
    clip = fracs is None
    limits = frac_limits(fracs) if limits is None else list(limits)
    units = _drawable(rows, table, keys, unit, n_draws, seed)
    numbers = units.select(F.col(GROUP)["_k"].alias("_k"), "_u", "_i", "_fix")
    joined = rows.withColumn("_u", F.col(unit)).join(numbers.hint("merge"), ["_u", "_k"])

    def score(name: str) -> Column:
        absent = F.raise_error(F.lit(f"{name} is NULL")).cast("double")
        known = F.coalesce(F.col(name).cast("double"), absent)
        return (clip_prob(known) if clip else known).alias("_s")

    sides = F.inline(F.array(*[F.struct(F.lit(n).alias("side"), score(name)) for n, name in enumerate(scores)]))
    # Read twice, the first time for the bounds of the ranges.
    met = stored(joined.select("_k", "row_id", F.col("y_true").cast("int").alias("_y"), "_i", "_fix", *scores))
    place = F.unhex(never_null(hash_text(F.col("row_id")), F.lit("0" * 32)))
    stacked = met.select("_k", place.alias("_h"), "_y", "_i", "_fix", sides)
    by = ["_k", "side", "draw"]
    names = stored(units.select(F.col(GROUP)["_k"].alias("_k"), "_name", F.col("_i__n").alias("_n")).distinct())
    wide = replicate_metrics(stacked, names, n_draws, seed, [(x.frac, x.pct) for x in limits], EPS)
    wide = evaluated_metrics(wide, by, limits) if clip else registered_metrics(wide, by, fracs)
    return wide, [c for c in wide.columns if c not in {*by, "n", "n_positive", "event_rate"}]


def resampled_pairs(
    paired: DataFrame,
    keys: Sequence[str],
    unit: str,
    n_draws: int,
    seed: int,
    *,
    limits: Sequence[Limit] | None = None,
    fracs: Sequence[float] | None = None,
) -> DataFrame:
    """(keys, draw, metric, value_a, value_b, n, n_positive) for pairs with ``risk_a``, ``risk_b``."""
    plain, table = _numbered(
        paired.select(*keys, "row_id", "y_true", "risk_a", "risk_b", *({unit} - {"row_id"})), keys
    )
    wide, names = _replicates(plain, table, keys, unit, n_draws, seed, ["risk_a", "risk_b"], limits, fracs)

    def of(side: int, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    both = wide.groupBy("_k", "draw").agg(
        F.max("n").alias("n"),
        F.max("n_positive").alias("n_positive"),
        *[of(0, m).alias(f"a_{m}") for m in names],
        *[of(1, m).alias(f"b_{m}") for m in names],
    )
    each = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("metric"),
                    F.col(f"a_{m}").alias("value_a"),
                    F.col(f"b_{m}").alias("value_b"),
                )
                for m in names
            ]
        )
    )
    return _renamed(both.select("_k", "draw", "n", "n_positive", each), table, keys)


def summarize_draws(
    df: DataFrame, keys: Sequence[str], value: str = "value", lone_std: float | None = 0.0
) -> DataFrame:
    """mean, std, 95 % interval and count of the valid draws; NULLs are left out.

    ``lone_std`` is the spread reported for a single valid draw: 0 in one family of summaries, NULL in
    the other. A group's size is the number of replicates, so the exact percentile is small.
    """
    v = F.col(value)
    band = F.percentile(v, F.array(F.lit(0.025), F.lit(0.975)))
    spread = F.stddev_samp(v)
    if lone_std is not None:
        spread = F.when(F.count(v) == 1, F.lit(lone_std)).otherwise(spread)
    out = df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), spread.alias("std"), band.alias("_band"), F.count(v).alias("n_valid")
    )
    return out.select(
        *keys, "mean", "std", F.get("_band", 0).alias("ci_low"), F.get("_band", 1).alias("ci_high"), "n_valid"
    )


def paired_delta(
    paired: DataFrame,
    keys: Sequence[str],
    *,
    unit: str = "row_id",
    n_draws: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """Difference a − b per metric with a bootstrap interval over ``unit`` (a row or a subject).

    All comparisons of the table are evaluated together; ``keys`` names them.
    """
    pairs = resampled_pairs(paired, keys, unit, n_draws, seed, limits=percent_limits(PERCENTS))
    delta = F.col("value_a") - F.col("value_b")
    drawn = F.when(F.col("draw") > 0, delta)
    observed = F.max(F.when(F.col("draw") == 0, delta))
    band = F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975)))
    summary = pairs.groupBy(*keys, "metric").agg(
        observed.alias("point_delta_a_minus_b"),
        F.avg(drawn).alias("bootstrap_mean_delta"),
        F.when(F.count(drawn) == 1, F.lit(0.0)).otherwise(F.stddev_samp(drawn)).alias("bootstrap_std_delta"),
        band.alias("_band"),
        F.count(drawn).alias("n_bootstrap_valid"),
        F.max(F.when(F.col("draw") == 0, F.col("n"))).alias("n_paired_examples"),
        F.max(F.when(F.col("draw") == 0, F.col("n_positive"))).alias("n_paired_positive"),
    )
    return summary.select(
        *keys,
        "metric",
        "point_delta_a_minus_b",
        "bootstrap_mean_delta",
        "bootstrap_std_delta",
        F.get("_band", 0).alias("ci_low"),
        F.get("_band", 1).alias("ci_high"),
        "n_bootstrap_valid",
        "n_paired_examples",
        "n_paired_positive",
    )


def cluster_delta(
    paired: DataFrame,
    keys: Sequence[str],
    *,
    cluster: str = "subject_id",
    n_draws: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """``paired_delta`` over clusters: all rows of a drawn cluster count, with multiplicity."""
    delta = paired_delta(paired, keys, unit=cluster, n_draws=n_draws, seed=seed)
    sizes = _unit_counts(paired, keys, cluster, "n_paired_patients")
    out = _attach(delta, sizes, keys)
    return out.select(
        *delta.columns[: delta.columns.index("n_paired_examples")],
        F.lit(n_draws).cast("long").alias("n_bootstrap_requested"),
        F.lit(cluster).alias("bootstrap_unit"),
        "n_paired_examples",
        "n_paired_patients",
        "n_paired_positive",
    )


def _unit_counts(df: DataFrame, keys: Sequence[str], unit: str, name: str) -> DataFrame:
    return df.select(*keys, unit).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on the keys as one struct, so that groups with a NULL key meet too."""
    rest = [c for c in right.columns if c not in keys]
    keyed = right.select(group_struct(keys).alias("_keys"), *rest)
    return left.withColumn("_keys", group_struct(keys)).join(keyed, "_keys").drop("_keys")


def patient_bootstrap_ci(
    df: DataFrame,
    keys: Sequence[str],
    fracs: Sequence[float],
    *,
    unit: str = "subject_id",
    n_draws: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """Observed value and bootstrap interval of every registered metric per key."""
    plain, table = _numbered(df.select(*keys, "row_id", "y_true", "risk", *({unit} - {"row_id"})), keys)
    wide, names = _replicates(plain, table, keys, unit, n_draws, seed, ["risk"], None, fracs)
    long = _renamed(
        unpivot_metrics(wide.select("_k", "draw", *names), ["_k", "draw"], names), table, keys
    )
    drawn = F.when(F.col("draw") > 0, F.col("value"))
    summary = long.groupBy(*keys, "metric").agg(
        F.max(F.when(F.col("draw") == 0, F.col("value"))).alias("observed"),
        F.avg(drawn).alias("bootstrap_mean"),
        F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975))).alias("_band"),
        F.stddev_samp(drawn).alias("bootstrap_std"),
        F.count(drawn).alias("n_bootstrap_valid"),
    )
    return summary.select(
        *keys,
        "metric",
        "observed",
        "bootstrap_mean",
        F.get("_band", 0).alias("ci_low"),
        F.get("_band", 1).alias("ci_high"),
        "bootstrap_std",
        "n_bootstrap_valid",
    )


def _two_sided(value: Column) -> Column:
    """Twice the smaller share of draws on either side of zero, at most 1."""
    share_low = F.avg((value <= 0).cast("double"))
    share_high = F.avg((value >= 0).cast("double"))
    return F.least(F.lit(1.0), 2 * F.least(share_low, share_high))


def paired_vs_baseline(
    aligned: DataFrame,
    keys: Sequence[str],
    fracs: Sequence[float],
    *,
    n_draws: int = 1000,
    seed: int = 42,
    subgroup: str | None = None,
) -> DataFrame:
    """Each version against the baseline version on the rows both have.

    ``aligned`` comes from ``align_to_baseline``: ``risk_compressed`` and ``risk_raw`` per row, with
    ``compressed_version`` and ``baseline_version``.
    """
    by = [*keys, "compressed_version", "baseline_version"]
    paired = aligned.select(
        *by,
        "row_id",
        "subject_id",
        "y_true",
        F.col("risk_compressed").alias("risk_a"),
        F.col("risk_raw").alias("risk_b"),
    )
    pairs = resampled_pairs(paired, by, "subject_id", n_draws, seed, fracs=fracs)
    diff = F.col("value_a") - F.col("value_b")
    drawn = F.when(F.col("draw") > 0, diff)

    def observed(c: Column) -> Column:
        return F.max(F.when(F.col("draw") == 0, c))

    summary = pairs.groupBy(*by, "metric").agg(
        observed(F.col("value_b")).alias("baseline_value"),
        observed(F.col("value_a")).alias("compressed_value"),
        observed(diff).alias("observed_diff_compressed_minus_baseline"),
        observed(F.col("n")).alias("n_examples_aligned"),
        observed(F.col("n_positive")).alias("n_positive_aligned"),
        F.avg(drawn).alias("bootstrap_mean_diff"),
        F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975))).alias("_band"),
        F.stddev_samp(drawn).alias("bootstrap_std_diff"),
        _two_sided(drawn).alias("p_two_sided_zero_diff"),
        F.count(drawn).alias("n_bootstrap_valid"),
    )
    sizes = _unit_counts(paired, by, "subject_id", "n_patients_aligned")
    out = _attach(summary, sizes, by).select(
        *by,
        "metric",
        (~F.col("metric").isin(LOWER_IS_BETTER)).alias("higher_is_better"),
        "baseline_value",
        "compressed_value",
        "observed_diff_compressed_minus_baseline",
        "n_examples_aligned",
        "n_patients_aligned",
        "n_positive_aligned",
        "bootstrap_mean_diff",
        F.get("_band", 0).alias("ci_low"),
        F.get("_band", 1).alias("ci_high"),
        "bootstrap_std_diff",
        "p_two_sided_zero_diff",
        "n_bootstrap_valid",
    )
    return out.withColumn("subgroup", F.lit(subgroup)) if subgroup else out


def paired_vs_baseline_by_subgroup(
    aligned: DataFrame,
    group: DataFrame,
    keys: Sequence[str],
    fracs: Sequence[float],
    *,
    n_draws: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """``paired_vs_baseline`` in the high-repeat group and outside it, each resampled on its own.

    ``group`` has ``high_repeat_group`` per (task, row_id, subject_id); rows it lacks take no part, and
    no row at all is an error.
    """
    on = ["task", "row_id", "subject_id"]
    flagged = require_rows(aligned.join(group.select(*on, "high_repeat_group").hint("merge"), on), "Subgroup merge")
    by = [*keys, "high_repeat_group"]
    out = paired_vs_baseline(flagged, by, fracs, n_draws=n_draws, seed=seed)
    return out.withColumn("subgroup", subgroup_label("high_repeat_group"))


FUSION_KEYS = ["task", "seed", "baseline_variant", "candidate_variant"]


def _seeded(paired: DataFrame) -> DataFrame:
    """Pairs of an ensemble have no seed and are reported under the ensemble's number."""
    return default_columns(paired, {"seed": F.lit(ENSEMBLE_SEED)})


def fusion_samples(paired: DataFrame, *, n_draws: int = 2000, seed: int = 42) -> DataFrame:
    """Every replicate of every (task, seed, comparison); replicate 0 is the observed data.

    ``paired`` has ``risk_baseline`` and ``risk_candidate`` per row beside the comparison's keys.
    """
    rows = _seeded(paired).select(
        *FUSION_KEYS,
        "row_id",
        "subject_id",
        "y_true",
        F.col("risk_candidate").alias("risk_a"),
        F.col("risk_baseline").alias("risk_b"),
    )
    pairs = resampled_pairs(
        rows, FUSION_KEYS, "subject_id", n_draws, seed, limits=frac_limits([p / 100 for p in PERCENTS])
    )
    lower = F.col("metric").isin(LOWER_IS_BETTER)
    delta = F.col("value_a") - F.col("value_b")
    return pairs.select(
        *FUSION_KEYS,
        F.col("draw").alias("bootstrap_id"),
        "metric",
        F.when(lower, "lower").otherwise("higher").alias("direction"),
        F.col("value_b").alias("baseline_value"),
        F.col("value_a").alias("candidate_value"),
        delta.alias("delta_candidate_minus_baseline"),
        F.when(lower, -delta).otherwise(delta).alias("improvement"),
        F.col("n").alias("n_rows"),
        "n_positive",
        (F.col("n_positive") / F.col("n")).alias("event_rate"),
    )


def fusion_sample_units(paired: DataFrame, *, n_draws: int = 2000, seed: int = 42) -> DataFrame:
    """Per replicate: subjects drawn, and how many different ones."""
    plain, table = _numbered(_seeded(paired).select(*FUSION_KEYS, "subject_id"), FUSION_KEYS)
    units = _drawable(plain, table, FUSION_KEYS, "subject_id", n_draws, seed)
    drawn = drawn_units(units.withColumn("_k", F.col(GROUP)["_k"]), "_k", n_draws, seed)
    out = drawn.select(
        "_k",
        F.col("draw").alias("bootstrap_id"),
        F.col("n_sampled").alias("n_subjects_sampled"),
        F.col("n_unique").alias("n_unique_subjects_sampled"),
    )
    return _renamed(out, table, FUSION_KEYS)


def fusion_summary(samples: DataFrame, paired: DataFrame, n_draws: int) -> DataFrame:
    """Observed values, signed improvement, intervals, P(improve) and p-value per comparison."""
    by = [*FUSION_KEYS, "metric", "direction"]
    is_draw = F.col("bootstrap_id") > 0

    def observed(c: str) -> Column:
        return F.max(F.when(~is_draw, F.col(c)))

    gain = F.when(is_draw, F.col("improvement"))
    delta = F.when(is_draw, F.col("delta_candidate_minus_baseline"))
    ends = F.array(F.lit(0.025), F.lit(0.975))
    summary = samples.groupBy(*by).agg(
        observed("n_rows").alias("n_rows"),
        observed("n_positive").alias("n_positive"),
        observed("event_rate").alias("event_rate"),
        observed("baseline_value").alias("baseline_observed"),
        observed("candidate_value").alias("candidate_observed"),
        observed("delta_candidate_minus_baseline").alias("delta_candidate_minus_baseline_observed"),
        F.percentile(delta, ends).alias("_delta"),
        observed("improvement").alias("improvement_observed"),
        F.percentile(gain, ends).alias("_gain"),
        F.avg((gain > 0).cast("double")).alias("prob_improvement"),
        _two_sided(gain).alias("p_two_sided_improvement"),
    )
    sizes = _unit_counts(_seeded(paired), FUSION_KEYS, "subject_id", "n_subjects")
    return _attach(summary, sizes, FUSION_KEYS).select(
        *by,
        "n_rows",
        "n_subjects",
        "n_positive",
        "event_rate",
        "baseline_observed",
        "candidate_observed",
        "delta_candidate_minus_baseline_observed",
        F.get("_delta", 0).alias("delta_ci_low"),
        F.get("_delta", 1).alias("delta_ci_high"),
        "improvement_observed",
        F.get("_gain", 0).alias("improvement_ci_low"),
        F.get("_gain", 1).alias("improvement_ci_high"),
        "prob_improvement",
        "p_two_sided_improvement",
        F.lit(n_draws).cast("long").alias("n_boot"),
    )


# ---------------------------------------------------------------- named pairs of model configurations


def pairwise_comparisons(
    ensemble: DataFrame,
    configs: Sequence[dict],
    comparisons: Sequence[dict],
    *,
    n_draws: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """Every named pair of configurations in both subgroups, resampled by subject together.

    ``configs`` entries have key, task, family, version, model; ``comparisons`` entries have
    comparison, description, task, a, b (config keys). Unknown keys are rejected before any job, and a
    comparison without common rows is an error.
    """
    known = {c["key"]: c for c in configs}
    if len(known) != len(configs):
        raise ValueError("Duplicate config key")
    unknown = sorted({c[s] for c in comparisons for s in "ab"} - set(known))
    if unknown:
        raise ValueError(f"Unknown config keys: {unknown}")
    on = ["task", "family", "version", "model"]
    spark = ensemble.sparkSession
    # Both tables are as long as the caller's lists.
    config_rows = local_table(
        spark,
        [[c["key"], *[c[k] for k in on]] for c in configs],
        "variant string, task string, family string, version string, model string",
    )
    keyed = ensemble.join(F.broadcast(config_rows), on)
    row = ["task", "group_name", "row_id", "subject_id", "y_true"]
    met = paired_variants(keyed, [(c["b"], c["a"]) for c in comparisons], row)

    def label(key: str) -> str:
        c = known[key]
        return f"{c['family']}: {c['version']} + {c['model']}"

    names = local_table(
        spark,
        [
            [c["task"], c["a"], c["b"], c["comparison"], c["description"], label(c["a"]), label(c["b"])]
            for c in comparisons
        ],
        "task string, candidate_variant string, baseline_variant string, comparison string,"
        " description string, model_a string, model_b string",
    )
    titles = ["comparison", "description", "model_a", "model_b"]
    paired = met.join(F.broadcast(names), ["task", "candidate_variant", "baseline_variant"]).select(
        *row,
        *titles,
        F.col("risk_candidate").alias("risk_a"),
        F.col("risk_baseline").alias("risk_b"),
    )
    paired = stored(paired)
    present = {r["comparison"] for r in paired.select("comparison").distinct().collect()}
    missing = sorted({c["comparison"] for c in comparisons} - present)
    if missing:
        raise ValueError(f"No common rows in comparisons {missing}")
    return cluster_delta(paired, ["task", "group_name", *titles], n_draws=n_draws, seed=seed)
