"""Vector columns in tasks and a small k-means, shared by the vector operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrisk.llm.common import tidy


def sound(vector: Column) -> Column:
    """Not NULL, not empty, not zero, all components finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centres by Lloyd's rounds from a random start; an empty cluster takes a random row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        count = np.bincount(own, minlength=len(centres))
        empty = count == 0
        centres = total / np.maximum(count, 1)[:, None]
        centres[empty] = x[rng.choice(len(x), int(empty.sum()))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row, in blocks."""
    half = (centres**2).sum(axis=1) / 2
    out = [(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]
    return np.concatenate(out) if out else np.zeros(0, int)


def per_cell(
    rows: DataFrame, keys: list[str], work: Callable[[dict[str, pa.Array]], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Run ``work`` on all rows of each value of ``keys``; a value's rows must be of bounded number.

    The rows are shuffled and sorted by the keys and streamed, so a task holds one cell at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.Table.from_batches(held).combine_chunks()
                columns = {n: whole.column(n).combine_chunks() for n in whole.column_names}
                columns = {n: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for n, c in columns.items()}
                made = work(columns)
                if made is not None and made.num_rows:
                    yield made

        for batch in batches:
            at = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys)))
            begin = 0
            for i in range(1, len(at) + 1):
                if i < len(at) and at[i] == at[begin]:
                    continue
                if at[begin] != cell:
                    yield from close()
                    held, cell = [], at[begin]
                held.append(batch.slice(begin, i - begin))
                begin = i
        yield from close()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)
