"""Joins between prediction tables, audits and code lists.

Tables with a row per example are merged by hint. Their keys compress so well that adaptive execution takes a table of
millions of rows for a small one and gathers it at the driver to broadcast it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrisk.plans.joins import local_table, row_partitions


PAIR_KEYS = ["task", "row_id", "subject_id", "y_true"]
#: Key hashes of the baseline that a filter lists at most; with more keys the join alone decides.
MAX_KEYS = 1000


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail if the table is empty; reads at most one row."""
    if df.isEmpty():
        raise ValueError(f"{what} produced 0 rows")
    return df


def paired_join(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str] = PAIR_KEYS,
    names: tuple[str, str] = ("risk_a", "risk_b"),
    check: bool = False,
) -> DataFrame:
    """Two models' scores for the rows both have."""
    left = a.select(*keys, F.col("risk").alias(names[0]))
    right = b.select(*keys, F.col("risk").alias(names[1]))
    out = left.join(right.hint("merge"), list(keys))
    return require_rows(out, "Paired merge") if check else out


def paired_variants(
    pred: DataFrame, comparisons: Sequence[tuple[str, str]], keys: Sequence[str]
) -> DataFrame:
    """Baseline and candidate score per row for every listed comparison, in one aggregation.

    Each row is offered to the comparisons its variant takes part in, then rows are met by key; a
    row without both sides is dropped. ``keys`` includes the row's identity and its label.
    """
    listed = F.array(
        *[
            F.struct(F.lit(b).alias("baseline_variant"), F.lit(c).alias("candidate_variant"))
            for b, c in comparisons
        ]
    )
    mine = F.filter(
        listed,
        lambda x: (x["baseline_variant"] == F.col("variant"))
        | (x["candidate_variant"] == F.col("variant")),
    )
    offered = pred.select(*keys, "variant", "risk", F.inline(mine))
    by = [*keys, "baseline_variant", "candidate_variant"]
    met = offered.groupBy(*by).agg(
        F.max(F.when(F.col("variant") == F.col("baseline_variant"), F.col("risk"))).alias("risk_baseline"),
        F.max(F.when(F.col("variant") == F.col("candidate_variant"), F.col("risk"))).alias("risk_candidate"),
    )
    return met.where(F.col("risk_baseline").isNotNull() & F.col("risk_candidate").isNotNull())


def three_way_join(
    tabular: DataFrame, sequence: DataFrame, numeric: DataFrame, keys: Sequence[str], check: bool = False
) -> DataFrame:
    """Tabular, sequence and numeric-sequence tables on one key set."""
    out = tabular.join(sequence.hint("merge"), list(keys)).join(numeric.hint("merge"), list(keys))
    return require_rows(out, "Base score merge") if check else out


def validated_left_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], one_to_one: bool = False
) -> DataFrame:
    """Left join whose right keys must be unique; with ``one_to_one`` the left keys too.

    The check is part of the plan: the right side is grouped by its key (which the join needs
    anyway) and a repeated key raises when the job runs.
    """
    extra = [c for c in right.columns if c not in keys]

    def once(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        grouped = df.groupBy(*keys).agg(
            F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_r"), F.count(F.lit(1)).alias("_c")
        )
        repeated = F.raise_error(F.lit(f"{side} join keys are not unique"))
        value = F.when(F.col("_c") == 1, F.col("_r")).otherwise(repeated)
        return grouped.select(*keys, value.alias("_r")).select(
            *keys, *[F.col("_r")[c].alias(c) for c in rest]
        )

    if one_to_one:
        left = once(left, "left").select(*left.columns)
    found = once(right, "right").select(*keys, *extra)
    return left.join(found.hint("merge") if one_to_one else found, list(keys), "left")


def align_to_baseline(
    pred: DataFrame, baseline: str, keys: Sequence[str] = ("task", "model", "seed", "calibration")
) -> DataFrame:
    """Join every other version to the baseline version on the row; labels must agree.

    Rows under keys that the baseline does not have are left where they are: they meet nothing. The others are dealt to
    a number of tasks that goes by their rows, so that a task sorts what it can hold.
    """
    on = [*keys, "row_id", "subject_id"]
    # One column: a key that is a constant would leave the join's keys, and the rows would be dealt again.
    one = F.struct(*on).alias("_on")
    pred = pred.where(" and ".join(f"`{c}` is not null" for c in on))
    key = F.xxhash64(*keys)
    base = pred.where(F.col("version") == baseline)
    other = pred.where(F.col("version") != baseline)
    known = [r[0] for r in base.select(key).distinct().limit(MAX_KEYS + 1).collect()]
    if len(known) <= MAX_KEYS:
        other = other.where(key.isin(known))
    tasks = row_partitions(other)
    base = base.select(one, F.col("y_true").alias("_y_base"), F.col("risk").alias("risk_raw")).repartition(tasks, "_on")
    other = other.select(
        one,
        F.col("version").alias("compressed_version"),
        F.col("y_true").alias("_y"),
        F.col("risk").alias("risk_compressed"),
    ).repartition(tasks, "_on")
    same = F.when(F.col("_y") == F.col("_y_base"), F.col("_y_base")).otherwise(
        F.raise_error(F.concat(F.lit("Mismatched labels for version "), F.col("compressed_version")))
    )
    return other.join(base.hint("merge"), "_on").select(
        *[F.col("_on")[c].alias(c) for c in keys],
        "compressed_version",
        F.lit(baseline).alias("baseline_version"),
        F.col("_on")["row_id"].alias("row_id"),
        F.col("_on")["subject_id"].alias("subject_id"),
        same.alias("y_true"),
        "risk_compressed",
        "risk_raw",
    )


def dedup(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last"
) -> DataFrame:
    """One row per key: the last (or first) in load order.

    An aggregation rather than a window: copies are reduced before the shuffle, so a key with very
    many copies costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    position = F.struct(*order)
    pick, end = (F.max_by, F.max) if keep == "last" else (F.min_by, F.min)
    # The order is long (paths of files): it is carried once, and not at all beside the row that it picks.
    found = [pick(F.struct(F.lit(0).alias("_"), *rest), position).alias("_r"), end(position).alias("_p")]
    grouped = df.groupBy(*keys).agg(*found)
    return grouped.select(
        *keys, *[F.col("_r")[c].alias(c) for c in rest], *[F.col("_p")[c].alias(c) for c in order if c not in keys]
    ).select(*df.columns)


def config_table(spark, configs: Sequence[Mapping[str, str]]) -> DataFrame:
    """Config entries of the caller as a table; its size is the length of the list."""
    names = list(configs[0])
    schema = ", ".join(f"`{n}` string" for n in names)
    return local_table(spark, [[c[n] for n in names] for c in configs], schema)


def config_semi_join(pred: DataFrame, configs: Sequence[Mapping[str, str]]) -> DataFrame:
    """Rows that match any config entry on all of the entry's columns."""
    table = config_table(pred.sparkSession, configs)
    return pred.join(F.broadcast(table), table.columns, "left_semi")


def ensemble_features(df: DataFrame, tabular: Sequence[str], arrays: Mapping[str, int]) -> DataFrame:
    """One row per key: the tabular features of one seed and embeddings averaged over seeds.

    ``arrays`` maps each embedding column to its length. Seeds train separately, so an average mixes
    hidden spaces that are not aligned; it is kept because it is what the comparison is defined on.
    """
    ids = ["task", "split", "row_id", "subject_id", "y_true"]
    first = F.min_by(F.struct(F.lit(0).alias("_"), *tabular), "seed").alias("_tab")
    means = [
        F.avg(F.get(name, i)).alias(f"{name}__{i}") for name, size in arrays.items() for i in range(size)
    ]
    grouped = df.groupBy(*ids).agg(first, *means)
    return grouped.select(
        *ids,
        F.lit(-1).alias("seed"),
        *[F.col("_tab")[c].alias(c) for c in tabular],
        *[
            F.array(*[F.col(f"{name}__{i}") for i in range(size)]).alias(name)
            for name, size in arrays.items()
        ],
    )


def threshold_flag(df: DataFrame, thresholds: DataFrame, tasks: Sequence[str], value: str, threshold: str) -> DataFrame:
    """Attach each task's threshold and whether the value reaches it.

    The threshold table has one row per listed task, which bounds the broadcast.
    """
    table = thresholds.where(F.col("task").isin(*tasks)).select("task", threshold)
    flag: Column = F.col(value) >= F.col(threshold)
    return df.join(F.broadcast(table), ["task"], "left").withColumn("high_repeat_group", flag)
