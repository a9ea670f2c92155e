"""Uniform sharding with a hypergeometric communication matrix."""

from __future__ import annotations

from math import e, lgamma, log, sqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqrisk.llm.registry import query, table
from seqrisk.plans.joins import local_table, stored

SHARDS = 40
#: Rows of a shard that one task orders.
BLOCK = 100_000
#: Partitions up to which their matrix rows (8 bytes a shard) are broadcast.
BROADCAST_PARTITIONS = 10_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One hypergeometric number; numpy's own below its limit, ratio of uniforms above."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    total = good + bad
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)

    def weight(x: int) -> float:
        return -(lgamma(x + 1) + lgamma(good - x + 1) + lgamma(draws - x + 1) + lgamma(bad - draws + x + 1))

    mean = draws * (good / total)
    spread = sqrt(mean * (bad / total) * (total - draws) / (total - 1) + 0.5)
    width = 2 * sqrt(2 / e) * spread + 3 - 2 * sqrt(3 / e)
    top = weight(min(high, int((draws + 1) * ((good + 1) / (total + 2)))))
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = int(np.floor(mean + 0.5 + width * (v - 0.5) / u))
        if low <= x <= high and 2 * log(u) <= weight(x) - top:
            return x


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows each partition sends to each shard, as in a uniform shuffle of all rows.

    Row sums are ``counts``; column sums are equal but for one row. Each partition's row is multivariate
    hypergeometric, given what the partitions before it have sent.
    """
    rng = np.random.default_rng(seed)
    n = sum(counts)
    free = [n // shards + (j < n % shards) for j in range(shards)]
    matrix = []
    for count in counts:
        row, left, rest = [], count, sum(free)
        for room in free:
            rest -= room
            row.append(hypergeometric(rng, room, rest, left))
            left -= row[-1]
        free = [room - sent for room, sent in zip(free, row)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 20) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: a uniform shuffle under the law ``rows``.

    The rows are stored with their partition and place. The driver gets one count per partition and draws
    how many rows each sends to each shard; the partition permutes its rows locally and cuts them by those
    counts; the shard permutes what it got again. Shard sizes are exact, all placements equally likely,
    equal texts are spread like any other rows, and a rerun on the same stored rows agrees. A NULL text has
    size 16 and the checksum of no bytes; NULL ids and repeated rows are rows like others; an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("_at"),
        )
    ).withColumn("_part", F.shiftrightunsigned("_at", 33))
    sent = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in sent)
    ends = [np.cumsum(row).tolist() for row in communication_matrix([n for _, n in sent], shards, seed)]
    matrix = local_table(spark, [(p, x) for (p, _), x in zip(sent, ends)], "_part bigint, _ends array<bigint>")
    matrix = F.broadcast(matrix) if len(sent) <= BROADCAST_PARTITIONS else matrix.hint("merge")
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed), "_at"), "_at")
    dealt = rows.withColumn("_nth", F.row_number().over(local)).join(matrix, "_part")
    shard = F.size(F.filter("_ends", lambda end: end < F.col("_nth")))
    again = F.xxhash64(F.lit(-seed - 1), "_at")
    bits = max(1, min(24, int(total / shards / BLOCK).bit_length()))
    dealt = stored(
        dealt.select(
            "doc_id", "size", "text_crc32", "_at", shard.alias("shard"), again.alias("_again"),
            F.shiftrightunsigned(again, 64 - bits).alias("_block"),
        )
    )
    blocks = dealt.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_in"))
    earlier = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select("shard", "_block", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_head"))
    inside = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_again", "_at"))
    return dealt.join(heads.hint("shuffle_hash"), ["shard", "_block"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_head") + inside - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_hypergeometric_shards")
def op7_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(table(spark, sf_dir, "documents"))
