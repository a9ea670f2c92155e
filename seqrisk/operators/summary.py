"""Summaries over datasets, seeds and predictions.

Lengths and counts of events take few distinct values, so their exact percentiles are aggregated
directly; measures that are continuous go through the bucketed quantile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrisk.functions.scalars import subgroup_label
from seqrisk.plans.ordered import GROUP, exact_quantiles, group_struct, ungroup

MODEL_KEYS = ["task", "family", "source", "version", "model", "calibration", "high_repeat_group"]
EXAMPLE_KEYS = [*MODEL_KEYS, "row_id", "subject_id", "y_true"]
SUMMARY_METRICS = [
    "auroc", "auprc", "brier", "logloss",
    "top_5pct_precision", "top_10pct_precision", "top_20pct_precision",
]


def _quantile(c: str, q: float) -> Column:
    return F.percentile(F.col(c), F.lit(q))


def dataset_summary(df: DataFrame, by_split: bool = False) -> DataFrame:
    """Examples, subjects, positives, lengths and removed events per task and version."""
    keys = ["task", "version", "split"] if by_split else ["task", "version"]
    label = F.col("label").cast("long")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.count_distinct("subject_id").alias("n_subjects"),
        F.sum(label).alias("n_positive"),
        F.avg(label).alias("event_rate"),
        F.avg("seq_len").alias("mean_seq_len"),
        _quantile("seq_len", 0.5).alias("median_seq_len"),
        _quantile("seq_len", 0.9).alias("p90_seq_len"),
        _quantile("seq_len", 0.95).alias("p95_seq_len"),
        F.max("seq_len").cast("long").alias("max_seq_len"),
        F.avg("n_events_removed_vs_raw").alias("mean_events_removed_vs_raw"),
        _quantile("n_events_removed_vs_raw", 0.5).alias("median_events_removed_vs_raw"),
        _quantile("n_events_removed_vs_raw", 0.9).alias("p90_events_removed_vs_raw"),
        F.avg("n_synthetic_events").alias("mean_synthetic_events"),
    )


def sequence_cost_summary(df: DataFrame) -> DataFrame:
    """Cost of each version over all, held-out, and held-out high-repeat examples.

    The groups overlap, so each row is expanded into its memberships and grouped once.
    ``high_repeat_group`` is NULL for rows outside the held-out split.
    """
    held_out = F.col("split") == "held_out"
    member = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(held_out, F.lit("held_out")),
            F.when(F.col("high_repeat_group"), F.lit("held_out_high_repeat")),
        )
    )
    rows = df.withColumn("group", F.explode(member)).drop("split")
    return rows.groupBy("task", "version", F.col("group").alias("split")).agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.count_distinct("subject_id").alias("n_patients"),
        F.avg("seq_len").alias("mean_seq_len"),
        _quantile("seq_len", 0.5).alias("median_seq_len"),
        _quantile("seq_len", 0.9).alias("p90_seq_len"),
        F.max("seq_len").cast("long").alias("max_seq_len"),
        F.avg("n_events_removed_vs_raw").alias("mean_events_removed_vs_raw"),
        _quantile("n_events_removed_vs_raw", 0.5).alias("median_events_removed_vs_raw"),
        _quantile("n_events_removed_vs_raw", 0.9).alias("p90_events_removed_vs_raw"),
        F.avg("n_synthetic_events").alias("mean_synthetic_events"),
        F.avg("n_compressible_chronic_events_raw").alias("mean_compressible_chronic_events_raw"),
    )


def run_sanity(pred: DataFrame) -> DataFrame:
    """What was loaded: seeds, rows, examples, patients, positives per model.

    Examples and patients are each counted in two levels (distinct pairs, then pairs per model), so no
    row is copied per counted column; seeds are few and kept as a set. Models with a NULL key stay.
    """
    keys = ["task", "version", "model", "calibration"]
    rows = pred.select(group_struct(keys).alias(GROUP), "seed", "row_id", "subject_id", "y_true")

    def distinct(column: str, name: str) -> DataFrame:
        return rows.select(GROUP, column).distinct().groupBy(GROUP).agg(F.count(column).alias(name))

    seeds = F.sort_array(F.collect_set("seed"))
    totals = rows.groupBy(GROUP).agg(
        seeds.alias("_seeds"), F.count(F.lit(1)).alias("n_rows"), F.sum("y_true").alias("n_positive")
    )
    joined = totals.join(distinct("row_id", "n_examples"), GROUP).join(distinct("subject_id", "n_patients"), GROUP)
    out = joined.select(
        GROUP,
        F.size("_seeds").cast("long").alias("n_seeds"),
        F.concat_ws(",", F.transform("_seeds", lambda s: s.cast("string"))).alias("seeds"),
        "n_rows",
        "n_examples",
        "n_patients",
        "n_positive",
    )
    return ungroup(out, keys)


def _four(c: str) -> list[Column]:
    return [
        F.avg(c).alias(f"{c}__mean"),
        F.stddev_samp(c).alias(f"{c}__std"),
        F.min(c).alias(f"{c}__min"),
        F.max(c).alias(f"{c}__max"),
    ]


def seed_summary(
    metrics: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] = SUMMARY_METRICS,
    first: Sequence[str] = (),
) -> DataFrame:
    """mean, std, min and max of each metric over seeds, with seed counts, in one aggregation.

    Groups with a NULL key are left out; ``first`` columns are taken from the lowest seed.
    """
    known = metrics.dropna(subset=list(keys))
    return known.groupBy(*keys).agg(
        F.count_distinct("seed").alias("n_seeds"),
        *[F.min_by(c, "seed").alias(c) for c in first],
        *[a for c in columns for a in _four(c)],
    )


def metric_mean_std(
    metrics: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Mean and sample deviation over seeds; the deviation of one value is NULL."""
    return metrics.groupBy(*keys).agg(
        F.count_distinct("seed").alias("n_seeds"),
        *[a for c in columns for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))],
    )


def steady_mean(c: str) -> Column:
    """Mean that does not depend on the order of addition.

    Examples with the same scores must get the same mean: a difference in the last bit would break a
    tie and move every ranking metric from run to run.
    """
    return F.avg(F.col(c).cast("decimal(28,18)")).cast("double")


def _spread(c: str) -> Column:
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def prediction_stability(df: DataFrame) -> DataFrame:
    """Per example: mean and deviation of the risk over seeds (0 for one seed)."""
    return df.groupBy(*EXAMPLE_KEYS).agg(
        steady_mean("risk").alias("risk_mean"),
        _spread("risk").alias("risk_std"),
        F.count_distinct("seed").alias("n_seeds"),
    ).withColumn("group_name", subgroup_label("high_repeat_group"))


def stability_summary(by_example: DataFrame) -> DataFrame:
    """Distribution of that deviation per model and subgroup."""
    keys = [*MODEL_KEYS, "group_name"]
    basic = by_example.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.sum("y_true").alias("n_positive"),
        F.avg("risk_std").alias("mean_prediction_std"),
        F.max("risk_std").alias("max_prediction_std"),
    )
    quantiles = exact_quantiles(
        by_example,
        keys,
        "risk_std",
        {"median_prediction_std": 0.5, "p90_prediction_std": 0.9, "p95_prediction_std": 0.95},
    )
    return basic.join(quantiles, keys)


def ensemble_predictions(df: DataFrame) -> DataFrame:
    """Mean risk over seeds per example."""
    return df.groupBy(*EXAMPLE_KEYS).agg(
        steady_mean("risk").alias("risk"),
        _spread("risk").alias("risk_std"),
        F.count_distinct("seed").alias("n_seeds"),
    ).withColumn("group_name", subgroup_label("high_repeat_group"))


def ensemble_base_scores(df: DataFrame) -> DataFrame:
    """Mean of the three score columns over seeds; the seed becomes −1."""
    scores = ["p_tabular", "p_sequence", "p_numeric_sequence"]
    return df.groupBy("task", "split", "row_id", "subject_id", "y_true").agg(
        *[steady_mean(c).alias(c) for c in scores]
    ).withColumn("seed", F.lit(-1))


def prediction_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y_true").alias("n_positive"),
        F.avg("y_true").alias("event_rate"),
    )


def bootstrap_across_seeds(summary: DataFrame) -> DataFrame:
    """Bootstrap summaries of single seeds, put together per comparison and metric."""
    return seed_summary(
        summary,
        ["task", "baseline_variant", "candidate_variant", "metric", "direction"],
        [
            "baseline_observed",
            "candidate_observed",
            "delta_candidate_minus_baseline_observed",
            "improvement_observed",
            "prob_improvement",
            "p_two_sided_improvement",
        ],
    )
