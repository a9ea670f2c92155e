"""Functions over packed sequence rows (parallel arrays). None of them shuffles.

Parallel arrays are zipped once and then transformed element by element. Looking up another array
inside a lambda would evaluate that array again for every element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqrisk.functions.scalars import nonnegative_day, safe_float

UNK_ID = 1


def _zip_to_first(**arrays: Column) -> Column:
    """array<struct> of the named arrays, as long as the first one; missing places are NULL."""
    filled = {n: F.coalesce(a, F.slice(F.array(F.lit(None)), 1, 0)) for n, a in arrays.items()}
    first = next(iter(filled.values()))
    zipped = F.arrays_zip(*[a.alias(n) for n, a in filled.items()])
    return F.slice(zipped, F.lit(1), F.size(first))


def normalize_arrays(codes: Column, days: Column, deltas: Column, nums: Column) -> Column:
    """Align the parallel arrays to the code array.

    Longer arrays lose their tail, shorter ones are padded: days and deltas with 0, numbers with
    NULL. The result is array<struct<code, day, delta, num>>.
    """
    return F.transform(
        _zip_to_first(code=codes, day=days, delta=deltas, num=nums),
        lambda e: F.struct(
            e["code"].cast("string").alias("code"),
            nonnegative_day(e["day"]).alias("day"),
            nonnegative_day(e["delta"]).alias("delta"),
            safe_float(e["num"]).alias("num"),
        ),
    )


def array_delta_days(days: Column, before: Column | None = None) -> Column:
    """Gap to the previous element, never negative; the first gap is 0.

    ``before`` is the day of the event that precedes the array, for a history cut into segments.
    """
    first = F.lit(None).cast("double") if before is None else before
    return F.transform(
        _zip_to_first(day=days, previous=F.concat(F.array(first), days)),
        lambda e: F.greatest(F.coalesce(e["previous"] - e["day"], F.lit(0.0)), F.lit(0.0)),
    )


def tail(array: Column, length: int) -> Column:
    """Last ``length`` elements; arrays that are shorter are kept whole."""
    start = F.greatest(F.size(array) - F.lit(length) + F.lit(1), F.lit(1))
    return F.slice(array, start, F.lit(length))


def tail_truncate(
    tokens: Column, days: Column, deltas: Column, nums: Column, length: int
) -> Column:
    """Last ``length`` events as array<struct<token_id, day, delta, num>>.

    An empty sequence becomes one unknown token at day 0.
    """
    unknown = F.array(
        F.struct(
            F.lit(UNK_ID).alias("token_id"),
            F.lit(0.0).alias("day"),
            F.lit(0.0).alias("delta"),
            F.lit(None).cast("double").alias("num"),
        )
    )
    events = F.transform(
        tail(_zip_to_first(token=tokens, day=days, delta=deltas, num=nums), length),
        lambda e: F.struct(
            e["token"].cast("int").alias("token_id"),
            F.coalesce(e["day"], F.lit(0.0)).alias("day"),
            F.coalesce(e["delta"], F.lit(0.0)).alias("delta"),
            e["num"].cast("double").alias("num"),
        ),
    )
    return F.when(F.size(events) > 0, events).otherwise(unknown)


def log_time(values: Column) -> Column:
    return F.transform(values, lambda v: F.log1p(F.greatest(v, F.lit(0.0))))
