"""Vocabularies, token ids and numeric statistics per token."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrisk.functions.codes import PAD, PAD_ID, UNK, UNK_ID
from seqrisk.plans.joins import local_table, lookup_join, stored
from seqrisk.plans.ordered import GROUP, dense_index, never_null, value_bucket

MIN_STD = 1e-6
MIN_VARIANCE = 1e-6
Z_BOUND = 10.0


def encode_tokens(events: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``token_id``; codes outside the vocabulary get the unknown id."""
    joined = lookup_join(events, vocab.select("code", "token_id"), ["code"], "left")
    return joined.select(
        *events.columns, F.coalesce("token_id", F.lit(UNK_ID)).cast("int").alias("token_id")
    )


def decode_tokens(events: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``code`` from ``token_id``; unknown ids become the unknown token.

    A vocabulary should not give one id to two codes; if it does, the alphabetically last code wins.
    """
    table = vocab.groupBy("token_id").agg(F.max("code").alias("code"))
    joined = lookup_join(events, table, ["token_id"], "left")
    return joined.select(*events.columns, F.coalesce("code", F.lit(UNK)).alias("code"))


def _base_vocab(source: DataFrame) -> DataFrame:
    """Source ids, and PAD and UNK where their ids are free."""
    by_id = source.groupBy("token_id").agg(F.min("code").alias("code"))
    kept = by_id.groupBy("code").agg(F.min("token_id").cast("int").alias("token_id"))
    special = local_table(
        source.sparkSession, [(PAD, PAD_ID), (UNK, UNK_ID)], "code string, token_id int"
    )
    added = (
        special.join(kept.select("code"), ["code"], "left_anti")
        .join(kept.select("token_id"), ["token_id"], "left_anti")
        .select("code", "token_id")
    )
    return kept.unionByName(added)


def build_vocabs(events: DataFrame, source: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by`` columns, ``code``, ``token_id``: one vocabulary for each group of training events.

    In each, source ids are kept, PAD and UNK added where their ids are free, and codes that the
    source lacks numbered from the highest id + 1 by falling count, then name. Numbering goes through
    count buckets per group, not through one sort.
    """
    base = stored(_base_vocab(source))
    highest = base.agg(F.max("token_id").alias("_top"))

    # One pass over the events; what follows works on the code counts.
    counts = stored(events.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n")))
    unseen = counts.join(base.select("code"), ["code"], "left_anti")
    grouped = unseen.withColumn(GROUP, F.struct(*by) if by else F.struct(F.lit(0).alias("_all")))
    order = [F.desc("n"), F.asc("code")]
    numbered = dense_index(grouped, order, never_null(-value_bucket(F.col("n")), F.lit(0)), "_i")
    appended = numbered.select(
        *by, "code", (highest.scalar() + 1 + F.col("_i")).cast("int").alias("token_id")
    )
    if not by:
        return base.unionByName(appended)
    # Every group has the source's entries; the groups are as many as there are versions.
    groups = counts.select(*by).distinct()
    return base.join(F.broadcast(groups)).select(*by, "code", "token_id").unionByName(appended)


def build_vocab(events: DataFrame, source: DataFrame) -> DataFrame:
    """One vocabulary for all training events, by the rules of ``build_vocabs``."""
    return build_vocabs(events, source)


def token_numeric_stats(events: DataFrame, vocab: DataFrame, min_count: int = 3) -> DataFrame:
    """Count, mean and population deviation of each token's numbers; one row for every id.

    Tokens with fewer than ``min_count`` numbers get mean 0 and deviation 1. ``events`` are training
    events with ``token_id`` and ``num`` (NULL when missing).
    """
    seen = events.where(F.col("num").isNotNull()).groupBy("token_id").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("num").alias("_mean"), F.var_pop("num").alias("_var")
    )
    joined = vocab.select("token_id").distinct().join(seen, ["token_id"], "left")
    n = F.coalesce("_n", F.lit(0))
    enough = n >= min_count
    return joined.select(
        "token_id",
        n.cast("long").alias("numeric_count_train"),
        F.when(enough, F.col("_mean")).otherwise(0.0).alias("numeric_mean_train"),
        F.when(enough, F.sqrt(F.greatest("_var", F.lit(MIN_VARIANCE)))).otherwise(1.0).alias("numeric_std_train"),
        enough.alias("has_enough_numeric_stats"),
    )


def numeric_zscore(events: DataFrame, stats: DataFrame) -> DataFrame:
    """Add ``z`` (bounded, 0 when the number is missing) and ``present``."""
    table = stats.select("token_id", "numeric_mean_train", "numeric_std_train")
    joined = lookup_join(events, table, ["token_id"], "left")
    spread = F.greatest(F.coalesce("numeric_std_train", F.lit(1.0)), F.lit(MIN_STD))
    z = (F.col("num") - F.coalesce("numeric_mean_train", F.lit(0.0))) / spread
    bounded = F.least(F.greatest(z, F.lit(-Z_BOUND)), F.lit(Z_BOUND))
    present = F.col("num").isNotNull()
    return joined.select(
        *events.columns,
        F.when(present, bounded).otherwise(0.0).alias("z"),
        F.when(present, 1.0).otherwise(0.0).alias("present"),
    )
