"""Ranks, running sums and exact quantiles over groups of any size.

``Window.partitionBy(group).orderBy(x)`` puts a whole group into one task. One model's scores may be
a third of all rows, so the functions here cut each group into value buckets first: the rows are
pre-aggregated map-side, a window runs over the few bucket totals, and a second window runs inside
(group, bucket). Each bucket function is monotone in the value, which keeps the results exact.
The bucket totals meet their rows by a shuffled hash join on the partitioning that the second window
needs anyway. The strategy is spelled out because the rows often come from an explode, whose size
the planner underestimates: it must not broadcast them.

Groups are carried as one struct column. Struct keys compare NULL fields as equal, so groups with a
NULL key survive the joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqrisk.plans.joins import stored

GROUP = "_g"
_FAR = 1 << 24
#: Rows (of pre-aggregated values) of a bucket that one task orders.
FINE = 1_000_000


def group_struct(keys: Sequence[str]) -> Column:
    """Key columns as one struct; an empty key list is one group."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))


def ungroup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key columns back in front of the others."""
    rest = [c for c in df.columns if c != GROUP]
    return df.select(*[F.col(GROUP)[k].alias(k) for k in keys], *rest)


def risk_bucket(p: Column) -> Column:
    """About 64 buckets per unit of log-odds; fine at both ends of (0, 1)."""
    odds = F.floor(F.ln(p / (F.lit(1.0) - p)) * F.lit(64.0)).cast("int")
    return F.when(p <= 0, -_FAR).when(p >= 1, _FAR).otherwise(odds)


def value_bucket(v: Column) -> Column:
    """About 64 buckets per doubling of the magnitude, for any real value."""
    size = F.floor(F.log2(F.lit(1.0) + F.abs(v) * F.lit(float(1 << 20))) * F.lit(64.0))
    return (F.signum(v) * size).cast("int")


def never_null(c: Column, instead: Column) -> Column:
    """Column the optimizer knows to be filled.

    A join on a nullable column puts an is-not-null filter into one branch only; the two branches
    then differ and their common shuffle is done twice.
    """
    return F.coalesce(c, instead)


def hash_text(c: Column, seed: object | None = None) -> Column:
    """Evenly spread, repeatable text key used for tie order, sampling and dense numbering."""
    text = c.cast("string")
    return F.md5(text if seed is None else F.concat_ws("|", F.lit(str(seed)), text))


def cut_buckets(df: DataFrame, order: str, most: int = FINE) -> DataFrame:
    """Add ``_sub``: a cut of the buckets (``_g``, ``_bucket``) with more than ``most`` rows, at their own quantiles.

    Fixed bucket widths leave most rows of a tightly spaced group in one bucket. Such a bucket is cut
    at 255 approximate quantiles of its values, so its pieces hold about equally many; ``_sub`` is the number
    of edges below the value, found in two steps of sixteen, and so monotone in it. At most one bucket for each
    ``most`` rows is broadcast.
    """
    edges = F.percentile_approx(order, F.array(*[F.lit(i / 256) for i in range(1, 256)]), F.lit(10_000))
    large = (
        df.groupBy(GROUP, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"), edges.alias("_edges"))
        .where(F.col("_rows") > most)
        .select(GROUP, "_bucket", "_edges")
    )
    v = F.col(order)
    outer = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.get("_edges", i * 16 - 1))
    first = F.size(F.filter(outer, lambda e: e < v))
    second = F.size(F.filter(F.slice("_edges", first * 16 + 1, F.lit(15)), lambda e: e < v))
    sub = F.when(F.col("_edges").isNotNull(), first * 16 + second).otherwise(0)
    return df.join(F.broadcast(large), [GROUP, "_bucket"], "left").select(*df.columns, sub.alias("_sub"))


def running_sums(
    df: DataFrame,
    order: str,
    bucket: Column,
    sums: Sequence[str],
    descending: bool = False,
    most: int = FINE,
) -> DataFrame:
    """Add ``<c>__upto`` (inclusive running sum) and ``<c>__all`` (group total) for each column.

    ``df`` has the group in ``_g`` and one row per (group, order value). Buckets of more than ``most``
    rows are cut further (``cut_buckets``).
    """
    def direction(name: str) -> Column:
        return F.desc(name) if descending else F.asc(name)

    marked = cut_buckets(df.withColumn("_bucket", never_null(bucket, F.lit(0))), order, most)
    totals = marked.groupBy(GROUP, "_bucket", "_sub").agg(*[F.sum(c).alias(f"{c}__in") for c in sums])
    over_buckets = Window.partitionBy(GROUP).orderBy(direction("_bucket"), direction("_sub"))
    earlier = over_buckets.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(GROUP)
    heads = totals.select(
        GROUP,
        "_bucket",
        "_sub",
        *[F.coalesce(F.sum(f"{c}__in").over(earlier), F.lit(0)).alias(f"{c}__head") for c in sums],
        *[F.sum(f"{c}__in").over(whole).alias(f"{c}__all") for c in sums],
    )
    inside = (
        Window.partitionBy(GROUP, "_bucket", "_sub")
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = marked.join(heads.hint("shuffle_hash"), [GROUP, "_bucket", "_sub"])
    return joined.select(
        *df.columns,
        *[(F.col(f"{c}__head") + F.sum(c).over(inside)).alias(f"{c}__upto") for c in sums],
        *[f"{c}__all" for c in sums],
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, names: dict[str, float]
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group; NULLs are skipped.

    ``names`` maps an output column to its fraction. The result, one row per group, is computed and
    stored here: joined into a larger plan, its key filters would reach only one of the two branches
    and the counting would be done twice.
    """
    base = df.where(F.col(value).isNotNull()).select(
        group_struct(keys).alias(GROUP), F.col(value).cast("double").alias("_v")
    )
    counts = base.groupBy(GROUP, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_sums(counts, "_v", value_bucket(F.col("_v")), ["_c"])
    last = F.col("_c__upto") - 1
    first = F.col("_c__upto") - F.col("_c")

    aggs = []
    for name, q in names.items():
        position = (F.col("_c__all") - 1) * F.lit(float(q))
        low, high = F.floor(position), F.ceil(position)
        aggs += [
            F.max(F.when((first <= low) & (low <= last), F.col("_v"))).alias(f"{name}__low"),
            F.max(F.when((first <= high) & (high <= last), F.col("_v"))).alias(f"{name}__high"),
            F.max(position - low).alias(f"{name}__part"),
        ]
    found = ranked.groupBy(GROUP).agg(*aggs)
    out = found.select(
        GROUP,
        *[
            (
                F.col(f"{n}__low")
                + (F.col(f"{n}__high") - F.col(f"{n}__low")) * F.col(f"{n}__part")
            ).alias(n)
            for n in names
        ],
    )
    return stored(ungroup(out, keys))


def take_in_hash_order(
    df: DataFrame, id_col: str, take: str, weight: str | None = None, seed: object | None = None
) -> DataFrame:
    """First ``take`` units of weight of each group ``_g`` in hash order of ``id_col``.

    Adds ``_taken``: how many of the row's copies fall inside the limit. Rows outside are dropped.
    ``take`` is a column that is constant within a group.
    """
    w = F.col(weight) if weight else F.lit(1)
    marked = df.withColumn("_h", hash_text(F.col(id_col), seed)).withColumn(
        "_hb", never_null(F.substring("_h", 1, 3), F.lit(""))
    )
    totals = marked.groupBy(GROUP, "_hb").agg(F.sum(w).alias("_in"))
    earlier = (
        Window.partitionBy(GROUP).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    )
    heads = totals.select(
        GROUP, "_hb", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_head")
    )
    inside = (
        Window.partitionBy(GROUP, "_hb")
        .orderBy("_h", id_col)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    kept = marked.join(heads.hint("shuffle_hash"), [GROUP, "_hb"]).where(F.col("_head") < F.col(take))
    before = F.col("_head") + F.sum(w).over(inside) - w
    return (
        kept.withColumn("_taken", F.greatest(F.lit(0), F.least(w, F.col(take) - before)))
        .where(F.col("_taken") > 0)
        .select(*df.columns, "_taken")
    )


def dense_index(df: DataFrame, order: Sequence[Column], bucket: Column, name: str) -> DataFrame:
    """0-based position of each row in its group ``_g`` under (bucket, order); a bucket is never NULL."""
    marked = df.withColumn("_bucket", bucket)
    totals = marked.groupBy(GROUP, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    earlier = (
        Window.partitionBy(GROUP).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    heads = totals.select(
        GROUP,
        "_bucket",
        F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_head"),
        F.sum("_in").over(Window.partitionBy(GROUP)).alias("_n"),
    )
    inside = Window.partitionBy(GROUP, "_bucket").orderBy(*order)
    return marked.join(heads.hint("shuffle_hash"), [GROUP, "_bucket"]).select(
        *df.columns,
        (F.col("_head") + F.row_number().over(inside) - 1).alias(name),
        F.col("_n").alias(f"{name}__n"),
    )
