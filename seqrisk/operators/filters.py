"""Filters, samples, ordered reports and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqrisk.plans.ordered import GROUP, take_in_hash_order


def split_filter(df: DataFrame, *splits: str) -> DataFrame:
    return df.where(F.col("split").isin(*splits))


def calibration_filter(df: DataFrame, calibration: str) -> DataFrame:
    """One calibration, or all of them."""
    return df if calibration == "all" else df.where(F.col("calibration") == calibration)


def task_filter(df: DataFrame, tasks: Sequence[str], check: bool = False) -> DataFrame:
    out = df.where(F.col("task").isin(*tasks))
    if check and out.isEmpty():
        raise ValueError(f"No rows left for tasks {list(tasks)}")
    return out


def head_limit(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    """First ``n`` examples for a trial run; 0 keeps all of them."""
    return df.orderBy(order).limit(n) if n > 0 else df


def seeded_subsample(df: DataFrame, n: int, seed: int, id_col: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer) chosen by seed, the same on every cluster.

    Rows are taken in hash order bucket by bucket, so neither the input nor the sample has to fit in
    one task.
    """
    grouped = df.withColumn(GROUP, F.struct(F.lit(0).alias("_all"))).withColumn("_n", F.lit(n))
    return take_in_hash_order(grouped, id_col, "_n", seed=seed).select(*df.columns)


def leakage_check(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest raw day and whether any event lies after the prediction.

    Works on unclamped days: once negative days are set to 0 nothing could be found.
    """
    lowest = F.min(F.array_min(F.filter("days_before_prediction", lambda d: ~F.isnan(d))))
    return df.groupBy(*keys).agg(
        lowest.alias("min_day"),
        F.count(F.lit(1)).alias("n_examples"),
        F.coalesce(lowest < F.lit(-1e-6), F.lit(False)).alias("has_future_events"),
    )


def assert_no_future_events(df: DataFrame) -> DataFrame:
    found = leakage_check(df).where("has_future_events").take(1)
    if found:
        raise ValueError(f"Found future events: min_days_before={found[0]['min_day']}")
    return df


def preview_topn(df: DataFrame, n: int, *order) -> DataFrame:
    """First rows of a sorted report."""
    return df.orderBy(*order).limit(n)


def rank_models(metrics: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    """Results ordered by task and falling average precision, with the rank in the task."""
    best = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("auprc"), "variant")
    return metrics.withColumn("rank", F.row_number().over(best)).orderBy(*keys, "rank")


def union_tables(*tables: DataFrame) -> DataFrame:
    """Append tables by column name; a column a table lacks is NULL there."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
