"""Exact quantiles of many features by radix selection: nine scans, however many features and rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# These functions travel to the executors by value, so that they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGIT = 8


def _ordered_bits(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    bits = (v + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _from_bits(x: int) -> float:
    bits = x ^ (1 << 63) if x >> 63 else x ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def array_quantiles(df: DataFrame, column: str, width: int, q: float) -> list[float | None]:
    """Linearly interpolated quantile of each of the first ``width`` places of an array of equal length in all rows.

    NULL and NaN entries are left out; a place without numbers has None. A scan counts, for the digits found so far, the
    next 8 bits of the values of all places at once; a task sends no more rows than it has digits, and what comes back
    is one digit for each value that is looked for (two per place).
    """
    numbers = df.select(column)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(width, np.int64)
        for batch in batches:
            n += (~np.isnan(_matrix(batch.column(0))[:, :width])).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(n)], ["j", "n"])

    counts = dict.fromkeys(range(width), 0)
    counts.update(numbers.mapInArrow(counted, "j long, n long").groupBy("j").agg(F.sum("n")).collect())
    places: list[tuple[int, int]] = []  # (place, rank)
    for j, n in counts.items():
        if n:
            at = (n - 1) * q
            places += sorted({(j, int(np.floor(at))), (j, int(np.ceil(at)))})
    state = {n: (j, rank, 0) for n, (j, rank) in enumerate(places)}  # place, rank left, digits so far
    for step in range(64 // DIGIT if places else 0):
        shift = 64 - DIGIT * (step + 1)
        asked = sorted({(j, prefix) for j, _, prefix in state.values()})

        def partial(batches: Iterator[pa.RecordBatch], asked=asked, shift=shift) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(asked), 1 << DIGIT), np.int64)
            for batch in batches:
                x, bits = _matrix(batch.column(0)), {}
                for k, (j, prefix) in enumerate(asked):
                    if j not in bits:
                        bits[j] = _ordered_bits(x[~np.isnan(x[:, j]), j])
                    own = bits[j] >> np.uint64(shift)
                    if shift + DIGIT < 64:
                        own = own[own >> np.uint64(DIGIT) == np.uint64(prefix)]
                    sums[k] += np.bincount((own & np.uint64((1 << DIGIT) - 1)).astype(np.int64), minlength=1 << DIGIT)
            for k in range(len(asked)):
                digits = np.flatnonzero(sums[k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(digits), k)), pa.array(digits), pa.array(sums[k, digits])], ["k", "digit", "n"])

        ranks = {k: sorted({rank for j, rank, prefix in state.values() if (j, prefix) == ask}) for k, ask in enumerate(asked)}

        def found(batches: Iterator[pa.RecordBatch], ranks=ranks) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                k, digit, n = (c.to_numpy() for c in batch.columns)
                for one in np.unique(k):
                    own = sums.setdefault(int(one), np.zeros(1 << DIGIT, np.int64))
                    np.add.at(own, digit[k == one], n[k == one])
            for one, own in sums.items():
                upto = np.cumsum(own)
                for rank in ranks[one]:
                    digit = int(np.searchsorted(upto, rank, "right"))
                    rest = rank - int(upto[digit] - own[digit])
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (one, rank, digit, rest)], ["k", "rank", "digit", "rest"])

        parts = numbers.mapInArrow(partial, "k long, digit long, n long").repartition("k")
        answers = {(r["k"], r["rank"]): (r["digit"], r["rest"]) for r in parts.mapInArrow(found, "k long, rank long, digit long, rest long").collect()}
        number = {ask: k for k, ask in enumerate(asked)}
        for n, (j, rank, prefix) in state.items():
            digit, rest = answers[number[j, prefix], rank]
            state[n] = (j, rest, prefix << DIGIT | digit)
    values = {places[n]: _from_bits(bits) for n, (_, _, bits) in state.items()}
    out: list[float | None] = []
    for j in range(width):
        at = (counts[j] - 1) * q
        if not counts[j]:
            out.append(None)
            continue
        low, high = values[j, int(np.floor(at))], values[j, int(np.ceil(at))]
        out.append(low + (high - low) * (at - np.floor(at)) if high != low else low)
    return out
