"""Grouped ranking and calibration metrics.

All metrics of all groups come out of one plan: rows are counted per (group, score) map-side, running
counts are formed over score buckets (see ``plans.ordered``), and top-k limits that fall inside a run
of equal scores are resolved on just those rows (with limits, the group totals are computed when
the frame is built). Weights make a row count several times, which is how
resampling is evaluated without copying rows.

Equal scores at a top-k limit are ordered by a hash of the row id, so the choice is repeatable and
unrelated to the order of ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrisk.functions.scalars import clip_prob, known_score
from seqrisk.plans.joins import lookup_join, stored
from seqrisk.plans.ordered import (
    GROUP,
    group_struct,
    never_null,
    risk_bucket,
    running_sums,
    take_in_hash_order,
    ungroup,
)

BASE_METRICS = ["auroc", "auprc", "brier", "logloss"]
TOP_FRACS = [0.01, 0.05, 0.10, 0.20]
SUBGROUP_FRACS = [0.05, 0.10, 0.20]
LOWER_IS_BETTER = ["brier", "logloss"]


@dataclass(frozen=True)
class Limit:
    """One top-k limit: ``ceil(n * frac)``, or ``ceil(n * pct / 100)`` when given in percent."""

    frac: float
    pct: int | None = None

    def k(self, n: Column) -> Column:
        raw = n * F.lit(self.frac) if self.pct is None else n * F.lit(float(self.pct)) / F.lit(100.0)
        return F.greatest(F.lit(1), F.ceil(raw)).cast("long")

    @property
    def percent(self) -> int:
        return self.pct if self.pct is not None else round(self.frac * 100)


def frac_limits(fracs: Sequence[float]) -> list[Limit]:
    return [Limit(float(f)) for f in fracs]


def percent_limits(percents: Sequence[int]) -> list[Limit]:
    return [Limit(p / 100, p) for p in percents]


def ranking_frame(
    df: DataFrame,
    keys: Sequence[str],
    limits: Sequence[Limit] = (),
    *,
    label: str = "y_true",
    risk: str = "risk",
    weight: str | None = None,
    row_id: str = "row_id",
    clip: bool = False,
) -> DataFrame:
    """Keys, ``n, n_positive, event_rate``, the four base metrics, and ``k_i, events_i`` per limit.

    ``clip`` clips scores before ranking, which makes ties at the extremes. The areas are NULL for a
    group with one class.
    """
    weighted = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    absent = F.raise_error(F.lit(f"{risk} is NULL")).cast("double")
    score = never_null(F.coalesce(F.col(risk).cast("double"), absent), F.lit(0.0))
    rows = df.select(
        group_struct(keys).alias(GROUP),
        (clip_prob(score) if clip else score).alias("_s"),
        F.col(label).cast("long").alias("_y"),
        weighted.alias("_w"),
        *([F.col(row_id).alias("_id")] if limits else []),
    )
    counts = rows.groupBy(GROUP, "_s").agg(
        F.sum(F.col("_w") * F.col("_y")).alias("_pos"),
        F.sum(F.col("_w") * (1 - F.col("_y"))).alias("_neg"),
    )
    ranked = running_sums(counts, "_s", risk_bucket(F.col("_s")), ["_pos", "_neg"], descending=True)

    pos, neg = F.col("_pos"), F.col("_neg")
    pos_upto, neg_upto = F.col("_pos__upto"), F.col("_neg__upto")
    p, n = F.col("_pos__all"), F.col("_pos__all") + F.col("_neg__all")
    upto = pos_upto + neg_upto
    above = upto - pos - neg
    q = clip_prob("_s")
    aggs = [
        F.max("_pos__all").alias("_p"),
        F.max("_neg__all").alias("_n"),
        F.sum(neg * (pos_upto - pos) + F.lit(0.5) * pos * neg).alias("_area"),
        F.sum(pos * pos_upto / upto).alias("_precision"),
        F.sum(pos * (1 - q) * (1 - q) + neg * q * q).alias("_square"),
        F.sum(-(pos * F.ln(q) + neg * F.ln(1 - q))).alias("_log"),
    ]
    for i, limit in enumerate(limits):
        k = limit.k(n)
        cut = (above < k) & (k < upto)
        aggs += [
            F.max(k).alias(f"k_{i}"),
            F.sum(F.when(upto <= k, pos).otherwise(F.when(cut & (neg == 0), k - above).otherwise(0)))
            .alias(f"_sure_{i}"),
            F.max(
                F.when(
                    cut & (pos > 0) & (neg > 0),
                    F.struct(
                        F.lit(i).alias("limit"), F.col("_s").alias("_s"), (k - above).alias("_take")
                    ),
                )
            ).alias(f"_tie_{i}"),
        ]
    groups = ranked.where(n > 0).groupBy(GROUP).agg(*aggs)

    if limits:
        groups = _resolve_ties(groups, rows, len(limits))

    total = F.col("_p") + F.col("_n")
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    out = groups.select(
        GROUP,
        total.alias("n"),
        F.col("_p").alias("n_positive"),
        (F.col("_p") / total).alias("event_rate"),
        F.when(both, F.col("_area") / (F.col("_p").cast("double") * F.col("_n"))).alias("auroc"),
        F.when(both, F.col("_precision") / F.col("_p")).alias("auprc"),
        (F.col("_square") / total).alias("brier"),
        (F.col("_log") / total).alias("logloss"),
        *[c for i in range(len(limits)) for c in (f"k_{i}", f"events_{i}")],
    )
    return ungroup(out, keys)


def _resolve_ties(groups: DataFrame, rows: DataFrame, n_limits: int) -> DataFrame:
    """Events among equal scores at a limit, counted on the rows that have those scores.

    The group totals are stored first. With continuous scores no limit falls inside a mixed run and
    the rows are not read again; otherwise the few (group, score) pairs are matched to the rows.
    """
    groups = stored(groups)
    ties = groups.select(
        GROUP, F.explode(F.array(*[f"_tie_{i}" for i in range(n_limits)])).alias("_tie")
    ).where(F.col("_tie").isNotNull())
    ties = ties.select(GROUP, "_tie.limit", "_tie._s", "_tie._take")
    if ties.isEmpty():
        sure = {f"events_{i}": F.col(f"_sure_{i}") for i in range(n_limits)}
        return groups.withColumns(sure)
    tied = lookup_join(rows, ties, [GROUP, "_s"], at_hand=True).select(
        F.struct(F.col(GROUP).alias("group"), F.col("limit")).alias(GROUP),
        "_id",
        "_y",
        "_w",
        "_take",
    )
    merged = tied.groupBy(GROUP, "_id", "_y").agg(
        F.sum("_w").alias("_w"), F.max("_take").alias("_take")
    )
    taken = take_in_hash_order(merged, "_id", "_take", "_w")
    found = taken.groupBy(F.col(f"{GROUP}.group").alias(GROUP)).agg(
        *[
            F.sum(F.when(F.col(f"{GROUP}.limit") == i, F.col("_taken") * F.col("_y"))).alias(f"_tied_{i}")
            for i in range(n_limits)
        ]
    )
    counted = {
        f"events_{i}": F.col(f"_sure_{i}") + F.coalesce(f"_tied_{i}", F.lit(0)) for i in range(n_limits)
    }
    return groups.join(found, [GROUP], "left").withColumns(counted)


def _precision(i: int) -> Column:
    return F.col(f"events_{i}") / F.col(f"k_{i}")


def auroc(df: DataFrame, keys: Sequence[str], clip: bool = False) -> DataFrame:
    return ranking_frame(df, keys, clip=clip).select(*keys, "auroc")


def auprc(df: DataFrame, keys: Sequence[str], clip: bool = False) -> DataFrame:
    return ranking_frame(df, keys, clip=clip).select(*keys, "auprc")


def brier(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap = clip_prob(known_score("risk")) - F.col("y_true")
    return df.groupBy(*keys).agg(F.avg(gap * gap).alias("brier"))


def logloss(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    q = clip_prob(known_score("risk"))
    loss = -F.when(F.col("y_true") == 1, F.ln(q)).otherwise(F.ln(1 - q))
    return df.groupBy(*keys).agg(F.avg(loss).alias("logloss"))


def ranking_metrics(df: DataFrame, keys: Sequence[str], clip: bool = False) -> DataFrame:
    """Counts, rate and the four base metrics in one row per group."""
    return ranking_frame(df, keys, clip=clip)


def topk_table(
    df: DataFrame, keys: Sequence[str], fracs: Sequence[float] = TOP_FRACS
) -> DataFrame:
    """One row per group and fraction: size of the top, events in it, rate, lift and capture."""
    wide = ranking_frame(df, keys, frac_limits(fracs))
    tops = F.array(
        *[
            F.struct(
                F.lit(float(f)).alias("top_frac"),
                F.col(f"k_{i}").alias("top_k"),
                F.col(f"events_{i}").alias("events_in_top_k"),
            )
            for i, f in enumerate(fracs)
        ]
    )
    rate = F.col("events_in_top_k") / F.col("top_k")
    return wide.select(*keys, "n", "n_positive", "event_rate", F.inline(tops)).select(
        *keys,
        "top_frac",
        "top_k",
        "events_in_top_k",
        rate.alias("top_k_event_rate"),
        F.try_divide(rate, F.col("event_rate")).alias("top_k_lift"),
        F.try_divide("events_in_top_k", "n_positive").alias("event_capture"),
        F.col("event_rate").alias("base_event_rate"),
        "n",
        "n_positive",
    )


def topk_precision(df: DataFrame, keys: Sequence[str], limit: Limit, clip: bool = False) -> DataFrame:
    return ranking_frame(df, keys, [limit], clip=clip).select(
        *keys, _precision(0).alias("precision")
    )


def topk_stats(df: DataFrame, keys: Sequence[str], frac: float) -> DataFrame:
    """Precision, lift and event capture of one fraction; NULL where the base is 0."""
    return ranking_frame(df, keys, frac_limits([frac])).select(
        *keys,
        _precision(0).alias("precision"),
        F.try_divide(_precision(0), F.col("event_rate")).alias("lift"),
        F.try_divide("events_0", "n_positive").alias("event_capture"),
    )


def metric_registry(fracs: Sequence[float]) -> list[tuple[str, bool]]:
    """Metric names in order, with whether higher is better."""
    names = list(BASE_METRICS)
    for f in fracs:
        pct = round(f * 100)
        names += [f"top{pct}_precision", f"top{pct}_lift", f"top{pct}_event_capture"]
    return [(m, m not in LOWER_IS_BETTER) for m in names]


def metrics_by_group(
    df: DataFrame,
    keys: Sequence[str],
    fracs: Sequence[float],
    *,
    weight: str | None = None,
    clip: bool = False,
) -> DataFrame:
    """Every registered metric for any key list; NULL keys form groups of their own."""
    return registered_metrics(ranking_frame(df, keys, frac_limits(fracs), weight=weight, clip=clip), keys, fracs)


def registered_metrics(wide: DataFrame, keys: Sequence[str], fracs: Sequence[float]) -> DataFrame:
    """Every registered metric from a frame with ``k_i`` and ``events_i`` per fraction."""
    tops = []
    for i, f in enumerate(fracs):
        pct = round(f * 100)
        tops += [
            _precision(i).alias(f"top{pct}_precision"),
            F.try_divide(_precision(i), F.col("event_rate")).alias(f"top{pct}_lift"),
            F.try_divide(f"events_{i}", "n_positive").alias(f"top{pct}_event_capture"),
        ]
    return wide.select(*keys, "n", "n_positive", "event_rate", *BASE_METRICS, *tops)


def evaluate_predictions(
    df: DataFrame,
    keys: Sequence[str],
    *,
    limits: Sequence[Limit] | None = None,
    weight: str | None = None,
    clip: bool = False,
) -> DataFrame:
    """Base metrics and the precision of the top 5, 10 and 20 percent."""
    limits = frac_limits(SUBGROUP_FRACS) if limits is None else list(limits)
    return evaluated_metrics(ranking_frame(df, keys, limits, weight=weight, clip=clip), keys, limits)


def evaluated_metrics(wide: DataFrame, keys: Sequence[str], limits: Sequence[Limit]) -> DataFrame:
    """Base metrics and precisions from a frame with ``k_i`` and ``events_i`` per limit."""
    return wide.select(
        *keys,
        "n",
        "n_positive",
        "event_rate",
        *BASE_METRICS,
        *[_precision(i).alias(f"top_{m.percent}pct_precision") for i, m in enumerate(limits)],
    )


def metric_by_name(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """One metric chosen by name, on clipped scores, as column ``value``."""
    if metric in BASE_METRICS:
        return ranking_frame(df, keys, clip=True).select(*keys, F.col(metric).alias("value"))
    if metric.startswith("top_") and metric.endswith("pct_precision"):
        pct = int(metric.removeprefix("top_").removesuffix("pct_precision"))
        return topk_precision(df, keys, percent_limits([pct])[0], clip=True).withColumnRenamed(
            "precision", "value"
        )
    raise ValueError(f"Unknown metric: {metric}")


def unpivot_metrics(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric table to (keys, metric, value)."""
    return wide.unpivot(list(keys), list(metrics), "metric", "value")
