"""Registration of queries, and the common form of their results."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqrisk.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType)
_NUMBERS = (T.FloatType, T.DoubleType, T.DecimalType)


def finish(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, numbers rounded to 6 places, everything else as it is."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _INTEGERS):
            c = c.cast("bigint")
        elif isinstance(f.dataType, _NUMBERS):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{uuid.uuid4().hex}-{name}")
