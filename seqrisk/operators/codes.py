"""Which codes are compressible: code lists, and inference from training histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrisk.functions.codes import is_diagnosis_name, is_special
from seqrisk.plans.joins import lookup_join, stored
from seqrisk.plans.ordered import exact_quantiles

MODES = ["strong_only", "strong_plus_possible"]


def diagnosis_flag(events: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """Add ``is_diagnosis``.

    With a code list: the trimmed code, or its upper-case form against the upper-cased list. Without
    one: the name rule. Special tokens are never a diagnosis.
    """
    if whitelist is None:
        return events.withColumn("is_diagnosis", is_diagnosis_name(F.col("code")))
    # An exact match implies an upper-case match, so one lookup answers both.
    listed = whitelist.select(F.upper(F.trim("code")).alias("_code")).distinct()
    listed = listed.withColumn("_hit", F.lit(True))
    marked = events.withColumn("_code", F.upper(F.trim("code")))
    joined = lookup_join(marked, listed, ["_code"], "left")
    flag = ~is_special(F.col("code")) & F.coalesce("_hit", F.lit(False))
    return joined.select(*events.columns, flag.alias("is_diagnosis"))


def whitelist_codes(
    strong: DataFrame, possible: DataFrame | None = None, mode: str = "strong_only"
) -> DataFrame:
    """Distinct codes of the strong list, or of both lists."""
    if mode not in MODES:
        raise ValueError(f"chronic code mode must be one of {MODES}, got {mode}")
    out = strong.select("code")
    if mode == "strong_plus_possible" and possible is not None:
        out = out.unionByName(possible.select("code"))
    return out.distinct()


def present_codes(whitelist: DataFrame, events: DataFrame) -> DataFrame:
    """The code list with ``present_in_cached_examples`` and ``selected_for_compression`` flags.

    The codes in use are found by a map-side combined distinct, so what is joined is code-sized.
    """
    used = events.select("code").distinct().withColumn("_used", F.lit(True))
    joined = whitelist.join(used, ["code"], "left")
    present = F.coalesce("_used", F.lit(False))
    return joined.select(
        *whitelist.columns,
        present.alias("present_in_cached_examples"),
        present.alias("selected_for_compression"),
    )


def infer_persistent_codes(
    events: DataFrame,
    min_subjects: int = 20,
    min_mean_occurrences: float = 2.0,
    min_span_days: float = 180.0,
    keep_all: bool = False,
) -> DataFrame:
    """Per diagnosis code: how many subjects repeat it and over how many days, and whether it is kept.

    ``events`` are training events with ``subject_id``, ``code``, ``day`` and ``is_diagnosis``. A
    common code has as many rows as it has subjects, so its medians come from the bucketed quantile.
    """
    per_subject = stored(
        events.where("is_diagnosis")
        .groupBy("code", "subject_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.greatest(F.max("day") - F.min("day"), F.lit(0.0)).alias("span"),
        )
    )
    basic = per_subject.groupBy("code").agg(
        F.count(F.lit(1)).alias("n_subjects"),
        F.count_if(F.col("n") >= 2).alias("n_repeated_subjects"),
        F.avg("n").alias("mean_occurrences_per_subject"),
    )
    occurrences = exact_quantiles(per_subject, ["code"], "n", {"median_occurrences_per_subject": 0.5})
    spans = exact_quantiles(
        per_subject, ["code"], "span", {"median_span_days": 0.5, "p75_span_days": 0.75}
    )
    keep = F.lit(keep_all) | (
        (F.col("n_subjects") >= min_subjects)
        & (F.col("mean_occurrences_per_subject") >= min_mean_occurrences)
        & (F.col("median_span_days") >= min_span_days)
    )
    return (
        basic.join(occurrences, "code")
        .join(spans, "code")
        .select(
            "code",
            "n_subjects",
            "n_repeated_subjects",
            "mean_occurrences_per_subject",
            "median_occurrences_per_subject",
            "median_span_days",
            "p75_span_days",
            keep.alias("selected_for_compression"),
            F.lit("inferred_from_cached_train_examples").alias("selection_source"),
        )
    )


def choose_codes(
    events: DataFrame, whitelist: DataFrame | None, **thresholds
) -> DataFrame:
    """Codes to compress: those of the list that occur, else the inferred ones."""
    if whitelist is not None:
        stats = present_codes(whitelist, events)
    else:
        stats = infer_persistent_codes(
            diagnosis_flag(events.where(F.col("split") == "train")), **thresholds
        )
    return stats.where("selected_for_compression").select("code").distinct()


def sort_code_stats(stats: DataFrame) -> DataFrame:
    return stats.orderBy(
        F.desc("selected_for_compression"),
        F.desc("n_subjects"),
        F.desc("mean_occurrences_per_subject"),
        F.desc("median_span_days"),
        "code",
    )


def code_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("code").union(b.select("code")).distinct()


def code_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("code").intersect(b.select("code"))
