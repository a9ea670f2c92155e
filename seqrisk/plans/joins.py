"""Join helpers whose strategy depends on a checked size."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqrisk.session import ensure_checkpoint_dir

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20


def lookup_join(
    big: DataFrame,
    table: DataFrame,
    on: Sequence[str] | Column,
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    at_hand: bool = False,
) -> DataFrame:
    """Join a code-sized table.

    The table is stored, so that what it is derived from runs once, and its rows and their bytes are added up,
    never past the limit of rows. Within ``max_rows`` and ``BROADCAST_BYTES`` the table is broadcast and the fact rows
    stay where they are; past either both sides are shuffled and merged, and adaptive execution splits hot keys.
    ``at_hand`` says that reading the table twice is cheap (a file, a stored table, a local list).
    """
    table = table if at_hand or table.isLocal() else stored(table)
    long = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(0))
    seen = table.select(long.cast("long").alias("_bytes")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("_bytes")).first()
    small = seen[0] <= max_rows and (seen[1] or 0) <= BROADCAST_BYTES
    return big.join(F.broadcast(table) if small else table.hint("merge"), on, how)


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes; entries of arrays and maps count by their fixed width."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType | T.MapType):
        each = len(kind.elementType.fields) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else 2
        return F.coalesce(F.size(c), F.lit(0)) * (8 * each) + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(c.getField(f.name), f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A list of the caller as a table that is part of the plan (no job reads it)."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    entries = [dict(zip(schema.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(entries, to_arrow_schema(schema)), schema)


def wide_partitions(df: DataFrame) -> int:
    """Partition count for steps whose work is much larger than their input."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def row_partitions(df: DataFrame, each: int = 250_000) -> int:
    """Partition count for about ``each`` rows in one task; counts the rows.

    Adaptive execution joins partitions by their compressed bytes. Rows whose keys and names compress well are some fifty
    times larger in the memory of a sort or an aggregation; an explicit count is left alone.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // each))


def stored(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write an intermediate as a table in the shared folder and go on from its files.

    For results that several branches read. The files outlive lost executors, each branch scans only
    the columns it needs, and the plan behind them is neither planned nor run again. A branch that asks for some values
    of the columns ``by`` reads their files only. ``release``
    removes a table that nothing reads any more; ``released`` scopes that to a block.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Remove the files of stored tables. What was read from them before must have been written."""
    for table in tables:
        path = getattr(table, "stored_path", None)
        if path:
            hadoop = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Lists of the open ``released`` blocks.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def released():
    """Remove every table that is stored inside the block when the block ends.

    A result that outlives the block must be written inside it, outside of the registered tables.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        release(*_OPEN.pop())


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, stored; the tables that it has stored on the way are removed.

    For results that are much smaller than what leads to them.
    """
    _OPEN.append([])
    try:
        out = make()
        between, _OPEN[-1] = _OPEN[-1], []
        kept = stored(out)
        _OPEN[-1] = between
    finally:
        release(*_OPEN.pop())
    if _OPEN:
        _OPEN[-1].append(kept)
    return kept
