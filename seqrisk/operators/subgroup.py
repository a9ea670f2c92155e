"""High-repeat subgroups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrisk.operators.joins import require_rows, threshold_flag, validated_left_join
from seqrisk.operators.ranking import metrics_by_group
from seqrisk.plans.joins import row_partitions
from seqrisk.plans.ordered import exact_quantiles

SOURCES = ["held_out", "train", "all"]


def high_repeat_threshold(audit: DataFrame, tasks: Sequence[str], source: str = "held_out", q: float = 0.9) -> DataFrame:
    """Per task: the q-quantile of the removed repeats over one split, or over all rows."""
    if source not in SOURCES:
        raise ValueError(f"threshold source must be one of {SOURCES}, got {source}")
    rows = audit.where(F.col("task").isin(*tasks))
    rows = rows if source == "all" else rows.where(F.col("split") == source)
    cut = exact_quantiles(
        rows, ["task"], "repeat_removed_first_last", {"repeat_removed_threshold": q}
    )
    sizes = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n_source_examples"))
    return sizes.join(cut, ["task"], "left").select(
        "task",
        F.lit(source).alias("threshold_source"),
        F.lit(float(q)).alias("q"),
        "repeat_removed_threshold",
        "n_source_examples",
    )


def audit_high_repeat(audit: DataFrame, thresholds: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Held-out audit rows with their flag. A threshold of 0 puts every row in the group."""
    flagged = threshold_flag(
        audit, thresholds, tasks, "repeat_removed_first_last", "repeat_removed_threshold"
    )
    return flagged.where(F.col("split") == "held_out")


def subgroup_join(pred: DataFrame, audit_held_out: DataFrame, check: bool = True) -> DataFrame:
    """Predictions of held-out audit rows, with the flag and the audit measures; none is an error."""
    extra = [
        "high_repeat_group", "repeat_removed_first_last", "raw_sequence_length_non_static",
        "n_diag_codes_persistent_365d",
    ]
    on = ["task", "row_id", "subject_id"]
    parts = row_partitions(pred)
    held = audit_held_out.select(*on, *extra).repartition(parts, *on)
    joined = pred.repartition(parts, *on).join(held.hint("merge"), on)
    return require_rows(joined, "Audit merge") if check else joined


def high_repeat_group(
    raw: DataFrame, first_last: DataFrame | None, tasks: Sequence[str], q: float = 0.9
) -> DataFrame:
    """Held-out examples whose first/last compression removes at least the q-quantile of events.

    Without an audit column the removed count is the difference of lengths; without a first/last
    version it is 0.
    """
    on = ["task", "row_id", "subject_id", "split"]
    held = raw.where((F.col("split") == "held_out") & F.col("task").isin(*tasks)).select(
        *on, "label", F.col("seq_len").alias("raw_seq_len")
    )
    if first_last is None:
        rows = held.withColumn("repeat_removed_proxy", F.lit(0.0))
    else:
        has_audit = "n_events_removed_vs_raw" in first_last.columns
        removed = F.col("n_events_removed_vs_raw") if has_audit else F.lit(None)
        short = first_last.where(F.col("split") == "held_out").select(
            *on, F.col("seq_len").alias("_len"), removed.cast("double").alias("_removed")
        )
        joined = validated_left_join(held, short, on, one_to_one=True)
        proxy = F.col("_removed") if has_audit else F.col("raw_seq_len") - F.col("_len")
        rows = joined.withColumn("repeat_removed_proxy", F.coalesce(proxy, F.lit(0)).cast("double"))
    cut = exact_quantiles(rows, ["task"], "repeat_removed_proxy", {"high_repeat_threshold": q})
    flagged = threshold_flag(rows, cut, tasks, "repeat_removed_proxy", "high_repeat_threshold")
    return flagged.select(
        "task", "row_id", "subject_id", "label", "repeat_removed_proxy", "high_repeat_group",
        "high_repeat_threshold",
    )


def subgroup_metrics_pair(
    pred: DataFrame, group: DataFrame, keys: Sequence[str], fracs: Sequence[float]
) -> DataFrame:
    """Metrics of the high-repeat and the other examples, side by side in one plan."""
    on = ["task", "row_id", "subject_id"]
    joined = pred.join(group.select(*on, "high_repeat_group").hint("merge"), on)
    return metrics_by_group(joined, [*keys, "high_repeat_group"], fracs)
