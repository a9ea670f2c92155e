"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqrisk.llm.common import WORD, numbered
from seqrisk.llm.registry import query, table
from seqrisk.plans.joins import lookup_join, stored

SHARES = (3, 1, 2)
BUDGET = Fraction(3, 2)
EPOCHS = 2
#: Hex digits of the hash that each refinement looks at; the last level takes whole hashes.
LEVELS = (3, 6, 32)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_size`` (words), ``_hash`` (of id and text) and ``_source``."""
    return docs.select(
        "*",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "text")).alias("_hash"),
        F.col("source").alias("_source"),
    )


def source_targets(
    rows: DataFrame, shares: Sequence[int] = SHARES, budget: Fraction = BUDGET, epochs: int = EPOCHS
) -> DataFrame:
    """``_from, source_size, target`` per source.

    Sources in code-point order, NULL last, weigh ``shares`` in turn. Their targets share ``budget``
    times all words by weight, none above ``epochs`` times its source; what is above is shared again. The
    level of the open sources is found by aggregates over the table of sources, so the driver sees
    two sums a round, not the sources.
    """
    totals = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    sources = numbered(totals, [F.col("_source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(int(s)) for s in shares]), (F.col("_rank") % len(shares) + 1).cast("int"))
    sources = stored(
        sources.select(
            F.col("_source").alias("_from"),
            "source_size",
            weight.cast("long").alias("_weight"),
            (F.col("source_size") * epochs).alias("_most"),
        )
    )
    level, closed = 0.0, -1
    share = F.lit(budget.numerator) * F.sum("source_size")
    while True:
        full = F.lit(level) * F.col("_weight") >= F.col("_most") if closed >= 0 else F.lit(False)
        got = sources.agg(
            share.alias("all"),
            F.coalesce(F.sum(F.when(full, F.col("_most"))), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0)).alias("open"),
            F.count(F.when(full, 1)).alias("closed"),
        ).first()
        if not got["open"] or got["closed"] == closed:
            break
        closed = got["closed"]
        level = ((got["all"] or 0) / budget.denominator - got["full"]) / got["open"]
    target = F.least(F.col("_most").cast("double"), F.lit(level) * F.col("_weight"))
    if not got["open"]:
        target = F.col("_most").cast("double")
    return sources.select("_from", "source_size", target.alias("target"))


def mix_plan(
    rows: DataFrame, shares: Sequence[int] = SHARES, budget: Fraction = BUDGET, epochs: int = EPOCHS
) -> DataFrame:
    """Per source: ``_from, source_size, target, _base`` (whole epochs), ``_cut, _with`` (hash threshold).

    Words are summed by source and hash bucket. The bucket in which the running sum meets the rest of
    the target is refined alone, level by level; only its rows are read again. A threshold for
    a smaller rest is a smaller hash, so mixes of growing budgets are nested.
    """
    targets = source_targets(rows, shares, budget, epochs)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = stored(targets.withColumn("_base", base.cast("long")))
    at = plan.select(
        "_from",
        (F.col("target") - F.col("_base") * F.col("source_size")).alias("_rest"),
        F.lit(0).cast("long").alias("_before"),
        F.lit("").alias("_prefix"),
    ).where(F.col("_rest") > 0)
    digits = 0
    for level in LEVELS:
        same = F.col("_source").eqNullSafe(F.col("_from")) & (F.substring("_hash", 1, digits) == F.col("_prefix"))
        near = lookup_join(rows.select("_source", "_size", "_hash"), at, same, at_hand=digits == 0)
        buckets = near.groupBy("_from", F.substring("_hash", 1, level).alias("_bucket")).agg(
            F.sum("_size").alias("_in"), F.first("_rest").alias("_rest"), F.first("_before").alias("_before")
        )
        upto = F.sum("_in").over(Window.partitionBy("_from").orderBy("_bucket"))
        held = buckets.withColumn("_upto", F.col("_before") + upto)
        at = held.where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_in") < F.col("_rest"))).select(
            "_from", "_rest", (F.col("_upto") - F.col("_in")).alias("_before"), F.col("_bucket").alias("_prefix"), "_in"
        )
        digits = level
    nearer = F.col("_before") + F.col("_in") - F.col("_rest") <= F.col("_rest") - F.col("_before")
    cuts = at.select(F.col("_from").alias("_cut_from"), F.col("_prefix").alias("_cut"), nearer.alias("_with"))
    joined = plan.join(cuts, F.col("_from").eqNullSafe(F.col("_cut_from")), "left")
    return stored(joined.select("_from", "source_size", "target", "_base", "_cut", "_with"))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the plan's columns and ``_copies``: how often the mix takes the row."""
    under = (F.col("_hash") < F.col("_cut")) | ((F.col("_hash") == F.col("_cut")) & F.col("_with"))
    joined = lookup_join(rows, plan, F.col("_source").eqNullSafe(F.col("_from")), at_hand=True)
    return joined.withColumn("_copies", F.col("_base") + F.coalesce(under, F.lit(False)).cast("long"))


def mix(
    docs: DataFrame, shares: Sequence[int] = SHARES, budget: Fraction = BUDGET, epochs: int = EPOCHS
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs`` (doc_id, text, source).

    A source takes whole epochs of its documents, then once more those whose hash is below the source's
    threshold, so it misses its target by less than one document. The hash is of id and text: rows
    equal in both go in together. NULL or empty texts have size 0; a NULL source is a source; an empty
    table gives no rows; other columns are ignored.
    """
    rows = stored(measured(docs.select("doc_id", "text", "source")).drop("text", "source"))
    return with_copies(rows, mix_plan(rows, shares, budget, epochs)).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, shares: Sequence[int] = SHARES, budget: Fraction = BUDGET, epochs: int = EPOCHS
) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them; names that begin with ``_`` are taken."""
    rows = stored(measured(docs.select("doc_id", "text", "source")).select("_size", "_hash", "_source"))
    plan = mix_plan(rows, shares, budget, epochs).drop("source_size", "target")
    mixed = with_copies(measured(docs), plan).where(F.col("_copies") > 0)
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws('|', CAST(doc_id AS VARCHAR), text)) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS BIGINT) AS most,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS k, (3 * sum(source_size) OVER () / 2.0
             - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
m AS (SELECT CAST(arg_min(level, k) FILTER (WHERE most > w * level) AS DOUBLE) AS level FROM l),
t AS (
  SELECT source, source_size, CAST(least(most, coalesce(m.level * w, most)) AS DOUBLE) AS target FROM s, m),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t),
r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (base + CASE WHEN rest > 0 AND (upto < rest OR (upto - own < rest AND upto - rest <= rest - (upto - own)))
                                THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


@query("op1_mix_sources", SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
