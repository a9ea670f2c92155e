"""Helpers of several operators: words, numbering, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqrisk.plans.joins import release, stored

#: A word of a text: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def give_back() -> None:
    """Return freed memory of this Python worker to the system.

    Workers are used again by later tasks, beside the executor's own heap; without this each keeps the most
    it ever had.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose texts are about to go to Python, after the session's Arrow batches were made smaller.

    Ten thousand whole texts, Spark's default, are tens of megabytes in the executor and again in
    each worker. A number that the caller has chosen stays.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, "1000")
    return docs


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that gives memory back when its task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the 0-based position under a total order, without bringing the rows into one task.

    The sorted rows are stored with the number of their partition; a running sum over the partition
    counts gives each partition its first position.
    """
    placed = stored(df.orderBy(*order).withColumn("_place", F.spark_partition_id()))
    heads = placed.groupBy("_place").agg(F.count(F.lit(1)).alias("_in"))
    earlier = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_place", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_head"))
    inside = F.row_number().over(Window.partitionBy("_place").orderBy(*order))
    return placed.join(F.broadcast(heads), "_place").select(
        *df.columns, (F.col("_head") + inside - 1).alias(name)
    )


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected edges: ``node, root`` for each node that is not its own root.

    Large-star and small-star rounds: every step is a minimum per node (combined before the shuffle) and
    a join on the node, which adaptive execution splits where a node is hot. No round makes more edges
    than the round before, each is written to the shared folder, and the driver sees two numbers.
    The root is the smallest node of the component. NULL ends and loops are no edges.
    """
    ends = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now, mark = _round(ends)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        following, after = _round(small.unionByName(low.select("u", F.col("m").alias("v"))))
        release(now, large)
        if after == mark:
            now = following
            break
        now, mark = following, after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _round(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The distinct edges, stored, with their count and a checksum, both read back from the stored files."""
    kept = stored(edges.distinct())
    mark = kept.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return kept, (mark[0], mark[1])
