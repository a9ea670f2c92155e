"""Weights of resampled units and weighted ranking metrics, all replicates of a row at once.

No weight is shipped: a row carries its unit's number and the few corrections of that unit, and any task makes the weights
of any unit from them. Rows are range-partitioned by (group, score, tie order), so a group or a score of
any size lies in many tasks; each task orders its rows and packs them into blocks of bounded size. A scan over the blocks' totals gives
every block the counts before it, and the blocks are then evaluated on their own. What is written grows with the rows,
not with rows times replicates.

Weights are multinomial: n draws with replacement from n units. Up to ``LEAF`` units (and in the forests, of any size) they
come from a tree of binomial splits over the units' numbers, seeded per node. More units have independent Poisson weights,
counted from a hash of (unit, replicate); given their total these are multinomial, and drawing what a replicate lacks, or
taking back what it has too much at random, gives exactly n draws. Those corrections are about sqrt(n) per replicate.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrisk.plans.joins import lookup_join, row_partitions, stored, wide_partitions
from seqrisk.plans.ordered import GROUP

# These functions travel to the executors by value, so that they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Units whose weights are drawn together.
LEAF = 1024
#: Row weights of a block, at most; weights that are made at a time, and those of whole rows, which stay in a core's cache.
CELLS, AT_ONCE, TILE = 1 << 24, 1 << 20, 1 << 17
#: Units of a task that adds up weights, replicates of a task that corrects them.
UNITS, STEP = 1 << 18, 64
#: Rows that a task orders in memory.
ORDERED = 1 << 20

Runner = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


# ---------------------------------------------------------------- draws


def _generator(*parts: object) -> np.random.Generator:
    text = "|".join(map(str, parts)).encode()
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(text).digest()[:16], "little")))


def leaf_weights(name: str, seed: int, n: int, leaf: int, n_draws: int) -> np.ndarray:
    """Weights of the units ``leaf * LEAF`` and on, a row each; column 0 is the observed data, weight 1.

    Column b says how often each unit is drawn in replicate b; over all n units a column adds up to n.
    """
    first, last = 0, -(-n // LEAF)
    drawn = np.full(n_draws, n, np.int64)
    while last - first > 1:
        middle = (first + last) // 2
        here, units = min(n, last * LEAF) - first * LEAF, (middle - first) * LEAF
        left = _generator(seed, name, first, last).binomial(drawn, units / here)
        if leaf < middle:
            last, drawn = middle, left
        else:
            first, drawn = middle, drawn - left
    units = min(n, last * LEAF) - first * LEAF
    picks = _generator(seed, name, first, "leaf").integers(0, units, int(drawn.sum()), dtype=np.uint16)
    cells = np.bincount(np.repeat(np.arange(n_draws) * units, drawn) + picks, minlength=n_draws * units)
    if cells.max(initial=0) > 255:
        raise ValueError("a unit was drawn more than 255 times")
    out = np.ones((units, n_draws + 1), np.uint8)
    out[:, 1:] = cells.astype(np.uint8).reshape(n_draws, units).T
    return out


#: P(weight <= k) of a Poisson weight, in 1/65536; what is above the last is below the precision of a double.
_UPTO = np.cumsum([exp(-1) / factorial(k) for k in range(19)]) * 65536
#: A 16-bit word weighs as many of the first as it is above; one that equals any, or reaches the last, is decided by more bits.
_STEPS, _RARE = np.floor(_UPTO[:4]).astype(np.uint16), np.uint16(_UPTO[4])
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The output function of SplitMix64, in place."""
    spare = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= np.right_shift(x, np.uint64(shift), out=spare)
        x *= np.uint64(factor)
    x ^= np.right_shift(x, np.uint64(31), out=spare)
    return x


def _states(name: str, seed: int, units: np.ndarray) -> np.ndarray:
    key = hashlib.sha256(f"{seed}|{name}|poisson".encode()).digest()[:8]
    return _mix(units.astype(np.uint64) * _GAMMA + np.frombuffer(key, "<u8")[0])


def _poisson(states: np.ndarray, begin: int, end: int) -> np.ndarray:
    """(units, end - begin) weights in the draws from ``begin``, a multiple of 4.

    A word of 64 bits has the weights of four draws; what 16 bits leave open is decided by 53 bits more.
    """
    counter = np.arange(begin // 4 + 1, (end + 3) // 4 + 1, dtype=np.uint64) * _GAMMA
    words = _mix(states[:, None] + counter)
    lanes = words.view(np.uint16)
    out, flag, edge = np.zeros(lanes.shape, np.uint8), np.empty(lanes.shape, bool), lanes >= _RARE
    for step in _STEPS:
        out += np.greater(lanes, step, out=flag).view(np.uint8)
        edge |= np.equal(lanes, step, out=flag)
    # Four flags are read as one number.
    fours = np.flatnonzero(edge.view(np.uint32))
    if len(fours):
        at = (fours[:, None] * 4 + np.arange(4)).ravel()
        at = at[edge.reshape(-1)[at]]
        more = _mix(words.reshape(-1)[at // 4] ^ _mix((at % 4).astype(np.uint64) + np.uint64(1)))
        exact = lanes.reshape(-1)[at] + (more >> np.uint64(11)).astype(np.float64) * 2.0**-53
        out.reshape(-1)[at] = np.searchsorted(_UPTO, exact, "right")
    return out[:, : end - begin]


def _poisson_at(states: np.ndarray, draw: int) -> np.ndarray:
    """Weights in one draw."""
    return _poisson(states, draw // 4 * 4, draw + 1)[:, -1]


def weight_columns(
    name: str, seed: int, n: int, n_draws: int, units: np.ndarray, fix_at: np.ndarray, fixes: np.ndarray
) -> Iterator[tuple[slice, np.ndarray]]:
    """Replicates and the weights of ``units`` in them, a few replicates at a time; replicate 0 is the observed data, weight 1.

    The corrections of unit number j of the list are ``fixes[fix_at[j]:fix_at[j + 1]]``: twice the draw, plus 1 for a draw more.
    """
    step = max(4, min(256, AT_ONCE // max(1, len(units))) // 4 * 4)
    if n <= LEAF:
        leaf = leaf_weights(name, seed, n, 0, n_draws)
        for at in range(0, n_draws + 1, step):
            part = slice(at, min(n_draws + 1, at + step))
            yield part, leaf[:, part][units]
        return
    states = _states(name, seed, units)
    owner, draw = np.repeat(np.arange(len(units)), np.diff(fix_at)), fixes >> 1
    more = np.where(fixes & 1, 1, 255).astype(np.uint8)
    order = np.argsort(draw, kind="stable")
    owner, draw, more = owner[order], draw[order], more[order]
    yield slice(0, 1), np.ones((len(units), 1), np.uint8)
    for at in range(0, n_draws, step):
        upto = min(n_draws, at + step)
        w = _poisson(states, at, upto)
        own = slice(*np.searchsorted(draw, [at, upto]))
        np.add.at(w, (owner[own], draw[own] - at), more[own])
        yield slice(at + 1, upto + 1), w


def weight_rows(
    name: str, seed: int, n: int, n_draws: int, units: np.ndarray, fix_at: np.ndarray, fixes: np.ndarray
) -> Iterator[tuple[slice, np.ndarray]]:
    """Places in ``units`` and their weights in the replicates from 1, a few units at a time; as ``weight_columns``."""
    step = max(1, TILE // n_draws)
    leaf = np.ascontiguousarray(leaf_weights(name, seed, n, 0, n_draws)[:, 1:]) if n <= LEAF else None
    states = None if n <= LEAF else _states(name, seed, units)
    for at in range(0, len(units), step):
        upto = min(len(units), at + step)
        if leaf is not None:
            yield slice(at, upto), leaf[units[at:upto]]
            continue
        w, own = _poisson(states[at:upto], 0, n_draws), fixes[fix_at[at] : fix_at[upto]]
        owner = np.repeat(np.arange(upto - at), np.diff(fix_at[at : upto + 1]))
        np.add.at(w, (owner, own >> 1), np.where(own & 1, 1, 255).astype(np.uint8))
        yield slice(at, upto), w


def _corrections(name: str, seed: int, n: int, draw: int, total: int) -> tuple[np.ndarray, bool]:
    """Units, repeats included, that get one draw more or one less, so that ``total`` draws become n; whether it is more."""
    rng = _generator(seed, name, draw, "correction")
    if total <= n:
        return rng.integers(0, n, n - total), True
    # Each draw is a (unit, number below the unit's weight), so pairs below the weight are draws, each as likely.
    most, need = len(_UPTO) + 1, total - n
    found = np.empty(0, np.int64)
    while len(found) < need:
        unit, number = np.split(rng.integers(0, [[n], [most]], (2, need * most + 64)), 2)
        unit, number = unit[0], number[0]
        hit = number < _poisson_at(_states(name, seed, unit), draw)
        found = np.concatenate([found, unit[hit] * most + number[hit]])
        _, first = np.unique(found, return_index=True)
        found = found[np.sort(first)]
    return found[:need] // most, False


def corrected_units(units: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """``units`` with ``_fix``, array<int>: what ``weight_columns`` needs beside a unit's number; NULL for none.

    ``units`` is cheap to read and has the group ``_g``, its units' numbers ``_i``, how many they are (``_i__n``) and ``_name``,
    the text that seeds the group.
    """
    large = units.where(F.col("_i__n") > LEAF).select(GROUP, "_name", "_i__n").distinct()
    kind = units.schema[GROUP].dataType.simpleString()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(1, np.int32)
        for batch in batches:
            sums = []
            for name, n, at in zip(*(batch.column(c).to_pylist() for c in ("_name", "_i__n", "_at"))):
                total = np.zeros(n_draws + 1, np.int64)
                for begin in range(at, min(n, at + UNITS), 1 << 14):
                    own = np.arange(begin, min(n, at + UNITS, begin + (1 << 14)))
                    for _, w in weight_rows(name, seed, n, n_draws, own, np.zeros(len(own) + 1, np.int32), none[:0]):
                        total[1:] += w.sum(axis=0, dtype=np.int32)
                sums.append(total.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (GROUP, "_name", "_i__n")), pa.array(sums, pa.binary())], [GROUP, "_name", "_i__n", "_sums"])

    def fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, (name, n, sums, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_name", "_i__n", "_sums", "_at")))):
                total = np.sum([np.frombuffer(x, np.int64) for x in sums], axis=0)
                for draw in range(at, min(n_draws, at + STEP)):
                    own, more = _corrections(name, seed, n, draw, int(total[draw + 1]))
                    group = batch.column(GROUP).take(pa.array(np.full(len(own), j)))
                    yield pa.RecordBatch.from_arrays([group, pa.array(own), pa.array(np.full(len(own), 2 * draw + more, np.int32))], [GROUP, "_i", "_code"])

    tasks = large.select("*", F.explode(F.sequence(F.lit(0), F.col("_i__n") - 1, F.lit(UNITS).cast("long"))).alias("_at"))
    parts = tasks.repartition(wide_partitions(units), GROUP, "_at").mapInArrow(added, f"_g {kind}, _name string, _i__n long, _sums binary")
    totals = parts.groupBy(GROUP, "_name", "_i__n").agg(F.collect_list("_sums").alias("_sums"))
    steps = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1), F.lit(STEP))).alias("_at"))
    fixes = steps.repartition(wide_partitions(units), GROUP, "_at").mapInArrow(fixed, f"_g {kind}, _i long, _code int")
    # A sort compares the first key by number.
    found = fixes.groupBy("_i", GROUP).agg(F.collect_list("_code").alias("_fix"))
    return units.join(found.hint("merge"), ["_i", GROUP], "left").select(*units.columns, "_fix")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than lists) and entries of a list column; NULL is empty."""
    lengths = np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), column.flatten().to_numpy().astype(np.int32)


def _weights_by_group(batch: pa.RecordBatch, n_draws: int, seed: int) -> Iterator[tuple[int, int, Iterator[tuple[slice, np.ndarray]]]]:
    """(begin, end, weights) of the runs of rows of one group in a batch of ``corrected_units``."""
    names, totals = batch.column("_name").to_pylist(), batch.column("_i__n").to_pylist()
    cuts = [0, *(j for j in range(1, len(names)) if names[j] != names[j - 1] or totals[j] != totals[j - 1]), len(names)]
    for begin, end in zip(cuts, cuts[1:]):
        if begin < end:
            own = batch.slice(begin, end - begin)
            units = own.column("_i").to_numpy()
            yield begin, end, weight_columns(names[begin], seed, totals[begin], n_draws, units, *_lists(own.column("_fix")))


def unit_vectors(units: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """``corrected_units`` as their other columns and ``_w``: a byte per replicate."""
    kept = [c for c in units.columns if c not in ("_name", "_i", "_i__n", "_fix")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = np.empty((batch.num_rows, n_draws + 1), np.uint8)
            for begin, end, columns in _weights_by_group(batch, n_draws, seed):
                for part, own in columns:
                    w[begin:end, part] = own
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([x.tobytes() for x in w], pa.binary())], [*kept, "_w"])

    return units.mapInArrow(run, units.select(*kept).schema.add("_w", "binary"))


def drawn_units(units: DataFrame, key: str, n_draws: int, seed: int) -> DataFrame:
    """(key, draw, n_sampled, n_unique): units drawn in each replicate, and how many different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            keys = batch.column(key).to_pylist()
            for begin, _, columns in _weights_by_group(batch, n_draws, seed):
                own = sums.setdefault(keys[begin], np.zeros((2, n_draws + 1), np.int64))
                for part, w in columns:
                    own[0, part] += w.sum(axis=0, dtype=np.int64)
                    own[1, part] += np.count_nonzero(w, axis=0)
        draws = pa.array(np.arange(n_draws + 1))
        for k, (total, unique) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * (n_draws + 1), pa.int32()), draws, pa.array(total), pa.array(unique)], names)

    names = ["k", "draw", "n", "u"]
    apart = units.select(F.col(key).cast("int").alias(key), "_name", "_i", "_i__n", "_fix").repartition(wide_partitions(units), key, "_i")
    parts = apart.sortWithinPartitions(key).mapInArrow(run, "k int, draw long, n long, u long")
    return parts.groupBy(F.col("k").alias(key), "draw").agg(F.sum("n").alias("n_sampled"), F.sum("u").alias("n_unique"))


# ---------------------------------------------------------------- blocks of ordered rows


def _vector(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def _numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.float64)


_EDGES = ["lead_pos", "lead_neg", "tail_pos", "tail_neg"]
_BLOCK = ["_k", "side", "part", "seq"]
_BLOCK_DDL = "_k int, side int, part long, seq long"
_HELD = ["scores", "labels", "units", "fix_at", "fixes"]


def _in_order(group: np.ndarray, s: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of rows by group, falling score and the 16 bytes of a hash (two numbers a row)."""
    order = np.argsort(hashes[:, 0])
    order = order[np.argsort(-s[order], kind="stable")]
    order = order[np.argsort(group[order], kind="stable")]
    a, b = order[:-1], order[1:]
    if ((group[a] == group[b]) & (s[a] == s[b]) & (hashes[a, 0] == hashes[b, 0])).any():
        return np.lexsort((hashes[:, 1], hashes[:, 0], -s, group))
    return order


def _moved(fix_at: np.ndarray, fixes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of corrections in another order."""
    lengths = np.diff(fix_at)[order]
    now = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return now, fixes[np.repeat(fix_at[:-1][order] - now[:-1], lengths) + np.arange(now[-1])]


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of ordered rows of one group, stored: scores, labels, numbers of units and their corrections."""
    names = [*_BLOCK, *_HELD]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        k, side, s, y, units = (table.column(i).to_numpy() for i in range(5))
        lists = _lists(pa.concat_arrays(table.column(5).chunks))
        text = pa.concat_arrays(table.column(6).chunks)
        hashes = np.frombuffer(text.buffers()[2], ">u8", 2 * len(text)).reshape(-1, 2).astype(np.uint64)
        group = k.astype(np.int64) << 32 | side
        order = _in_order(group, s, hashes)
        group, s, y, units = group[order], s[order], y[order], units[order]
        fix_at, fixes = _moved(*lists, order)
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)]
        starts = [(at, min(end, at + most)) for begin, end in zip(cuts, cuts[1:]) for at in range(begin, end, most)]
        for seq, (at, upto) in enumerate(starts):
            own = fix_at[at : upto + 1]
            held = (s[at:upto], y[at:upto], units[at:upto], own - own[0], fixes[own[0] : own[-1]])
            values = [int(group[at] >> 32), int(group[at] & 0xFFFFFFFF), TaskContext.get().partitionId(), seq, *(x.tobytes() for x in held)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

    # Scores fall, and md5 tells equal ones apart: a score of any size lies in many tasks.
    tasks = max(wide_partitions(rows), row_partitions(rows, ORDERED))
    dealt = rows.repartitionByRange(tasks, "_k", "side", F.desc("_s"), "_h")
    narrow = dealt.select("_k", "side", "_s", F.col("_y").cast("tinyint"), F.col("_i").cast("long"), "_fix", "_h")
    return stored(narrow.mapInArrow(run, _BLOCK_DDL + ", " + ", ".join(f"{c} binary" for c in _HELD)))


def _reordered(row: dict, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a block's units in another order, and their corrections."""
    units, fix_at, fixes = np.frombuffer(row["units"], np.int64), np.frombuffer(row["fix_at"], np.int32), np.frombuffer(row["fixes"], np.int32)
    return units[order], *_moved(fix_at, fixes, order)


class _Runs:
    """A block by runs of equal scores: weights are added up per run and label, a few replicates at a time."""

    def __init__(self, row: dict, n_draws: int, seed: int):
        self.scores, self.labels = np.frombuffer(row["scores"], np.float64), np.frombuffer(row["labels"], np.int8)
        s, y = self.scores, self.labels
        run = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        cell = run * 2 + (y != 0)
        self.order = np.argsort(cell, kind="stable")
        cell = cell[self.order]
        self.cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        self.cells, self.n = cell[self.cuts], int(run[-1]) + 1
        self.values = s[np.concatenate([[True], s[1:] != s[:-1]])]
        self.weights = weight_columns(row["_name"], seed, row["_n"], n_draws, *_reordered(row, self.order))

    def sums(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Replicates, weights of the positive and of the other rows per run, and the rows' weights by ``order``."""
        for part, w in self.weights:
            both = np.zeros((2 * self.n, w.shape[1]), np.int32)
            if len(self.cuts) == len(w):
                both[self.cells] = w
            else:
                both[self.cells] = np.add.reduceat(w, self.cuts, axis=0, dtype=np.int32)
            yield part, both[1::2], both[::2], w


def _end_sums(row: dict, n_draws: int, seed: int) -> tuple[int, np.ndarray]:
    """Runs of equal scores in a block, and its weights per replicate: positive and others of the first run, of the last, of those between."""
    scores, labels = np.frombuffer(row["scores"], np.float64), np.frombuffer(row["labels"], np.int8)
    place = np.where(scores == scores[0], 0, np.where(scores == scores[-1], 1, 2)) * 2 + (labels == 0)
    order = np.argsort(place, kind="stable")
    counts = np.bincount(place, minlength=6)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((6, n_draws + 1))
    out[:, 0] = counts
    for part, w in weight_rows(row["_name"], seed, row["_n"], n_draws, *_reordered(row, order)):
        for j in range(6):
            begin, end = max(cuts[j], part.start) - part.start, min(cuts[j + 1], part.stop) - part.start
            if begin < end:
                out[j, 1:] += w[begin:end].sum(axis=0, dtype=np.int32)
    return int(np.count_nonzero(scores[1:] != scores[:-1])) + 1, out


def _edges(blocks: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """Sums of each block per replicate, stored: over all rows, and over the first and the last run of equal scores.

    A run at the end of a block may go on in other blocks. A block of one run has no sums of runs beside its own.
    """
    names = [*_BLOCK, "first", "last", "runs", "pos", "neg", *_EDGES]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()] + [pa.binary()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                runs, ends = _end_sums(row, n_draws, seed)
                sums = [ends[::2].sum(axis=0), ends[1::2].sum(axis=0), *ends[:4]]
                scores = np.frombuffer(row["scores"], np.float64)
                values = [*(row[c] for c in _BLOCK), scores[0], scores[-1], runs, *(_vector(x) if n < 2 or runs > 1 else None for n, x in enumerate(sums))]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

    binary = ", ".join(f"{c} binary" for c in ("pos", "neg", *_EDGES))
    return stored(blocks.mapInArrow(run, f"{_BLOCK_DDL}, first double, last double, runs long, {binary}"))


def _run_terms(pos: np.ndarray, neg: np.ndarray, pos_before: np.ndarray, neg_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a run of equal scores adds to the area under the ROC curve (times both totals) and to the sum of precisions."""
    area = neg * pos_before + 0.5 * pos * neg
    upto = pos_before + pos + neg_before + neg
    return area, pos * np.divide(pos_before + pos, upto, out=np.zeros_like(upto), where=upto > 0)


def _losses(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray, clip: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of squares and of logs over runs of equal scores, weighted."""
    q = np.clip(scores, clip, 1 - clip)
    return (1 - q) ** 2 @ pos + q**2 @ neg, -(np.log(q) @ pos + np.log(1 - q) @ neg)


_END = ["area", "precision", "squares", "logs"]


def _heads(blocks: DataFrame, clip: float) -> DataFrame:
    """Per block the weights before it and its own; per group (``seq`` NULL) the totals and the terms of runs at the ends of blocks.

    A group's blocks stream through one task in order, a few numbers per replicate for thousands of rows.
    """
    names = [*_BLOCK, "runs", "head_pos", "head_neg", "pos", "neg", *_END]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3] + [pa.binary()] * (4 + len(_END))

    def out(key, part, seq, runs, *sums) -> pa.RecordBatch:
        vectors = [x if x is None else _vector(x) for x in sums] + [None] * (4 + len(_END) - len(sums))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*key, part, seq, runs, *vectors], kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = score = None
        pos = neg = area = precision = losses = None  # totals so far
        run_pos = run_neg = None  # of the open run, which began when the totals were these less it

        def close() -> None:
            nonlocal area, precision
            more = _run_terms(run_pos, run_neg, pos - run_pos, neg - run_neg)
            area, precision = area + more[0], precision + more[1]

        for batch in batches:
            for row in batch.to_pylist():
                own = (row["_k"], row["side"])
                if own != key:
                    if key is not None:
                        close()
                        yield out(key, None, None, None, pos, neg, None, None, area, precision, *losses)
                    key, score = own, None
                    pos = neg = area = precision = run_pos = run_neg = np.zeros(len(row["pos"]) // 8)
                    losses = np.zeros((2, len(pos)))
                block = {c: _numbers(row[c]) for c in ("pos", "neg")}
                block |= {c: block[c[5:]] if row[c] is None else _numbers(row[c]) for c in _EDGES}
                yield out(key, row["part"], row["seq"], row["runs"], pos, neg, block["pos"], block["neg"])
                if score is not None and row["first"] != score:
                    close()
                    run_pos = run_neg = np.zeros_like(pos)
                run_pos, run_neg = run_pos + block["lead_pos"], run_neg + block["lead_neg"]
                losses += _losses(np.array([row["first"]]), block["lead_pos"][None], block["lead_neg"][None], clip)
                if row["runs"] > 1:
                    before = pos, neg
                    pos, neg = pos + block["lead_pos"], neg + block["lead_neg"]
                    close()
                    pos, neg = before
                    run_pos, run_neg = block["tail_pos"], block["tail_neg"]
                    losses += _losses(np.array([row["last"]]), run_pos[None], run_neg[None], clip)
                pos, neg, score = pos + block["pos"], neg + block["neg"], row["last"]
        if key is not None:
            close()
            yield out(key, None, None, None, pos, neg, None, None, area, precision, *losses)

    read = blocks.select("_k", "side", "part", "seq", "first", "last", "runs", "pos", "neg", *_EDGES)
    ordered = read.repartition("_k", "side").sortWithinPartitions("_k", "side", "part", "seq")
    schema = f"{_BLOCK_DDL}, runs long, " + ", ".join(f"{c} binary" for c in ("head_pos", "head_neg", "pos", "neg", *_END))
    return stored(ordered.mapInArrow(run, schema))


def _top_sizes(n: np.ndarray, limits: Sequence[tuple[float, int | None]]) -> list[np.ndarray]:
    raw = [n * frac if pct is None else n * float(pct) / 100.0 for frac, pct in limits]
    return [np.maximum(1, np.ceil(r)) for r in raw]


def _opened(before: DataFrame, limits: Sequence[tuple[float, int | None]], n_draws: int) -> DataFrame:
    """Blocks whose rows count beyond their sums, stored, and per group (``seq`` NULL) ``_block_terms`` of what lies whole within a limit.

    Such blocks have a run that neither begins nor ends them, or are cut by a limit in some replicate.
    """
    names = [*_BLOCK, "head_pos", "head_neg", "terms"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole: dict = {}
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                v = {c: _numbers(row[c]) for c in ("head_pos", "head_neg", "pos", "neg", "all_pos", "all_neg")}
                both, before = v["pos"] + v["neg"], v["head_pos"] + v["head_neg"]
                left = [top - before for top in _top_sizes(v["all_pos"] + v["all_neg"], limits)]
                sums = whole.setdefault((row["_k"], row["side"]), np.zeros((4 + len(limits), n_draws + 1)))
                for j, x in enumerate(left):
                    sums[4 + j] += np.where(x >= both, v["pos"], 0)
                if row["runs"] > 2 or any(((x > 0) & (x < both)).any() for x in left):
                    values = [*(row[c] for c in (*_BLOCK, "head_pos", "head_neg")), None]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], names)
            for key, sums in whole.items():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*key, None, None, None, None, _vector(sums)], kinds)], names)

    return stored(before.mapInArrow(run, f"{_BLOCK_DDL}, head_pos binary, head_neg binary, terms binary"))


def _block_terms(row: dict, limits: Sequence[tuple[float, int | None]], clip: float, n_draws: int, seed: int) -> np.ndarray:
    """Sums of a block per replicate: area, precisions, squares and logs of the runs between its first and last, events of limits that cut it."""
    runs = _Runs(row, n_draws, seed)
    head_pos, head_neg = _numbers(row["head_pos"]), _numbers(row["head_neg"])
    tops = _top_sizes(_numbers(row["all_pos"]) + _numbers(row["all_neg"]), limits)
    back = np.argsort(runs.order)
    y = runs.labels != 0
    out = np.zeros((4 + len(limits), n_draws + 1))
    for c, pos, neg, w in runs.sums():
        both = pos.sum(axis=0) + neg.sum(axis=0)
        pos, neg = pos.astype(float), neg.astype(float)
        if runs.n > 2:
            out[2:4, c] = _losses(runs.values[1:-1], pos[1:-1], neg[1:-1], clip)
            pos_before, neg_before = head_pos[c] + np.cumsum(pos[:-2], axis=0), head_neg[c] + np.cumsum(neg[:-2], axis=0)
            area, precision = _run_terms(pos[1:-1], neg[1:-1], pos_before, neg_before)
            out[0, c], out[1, c] = area.sum(axis=0), precision.sum(axis=0)
        before = head_pos[c] + head_neg[c]
        for i, top in enumerate(tops):
            left = top[c] - before
            cut = np.flatnonzero((left > 0) & (left < both))
            if len(cut):
                own = w[:, cut][back]
                upto = np.cumsum(own, axis=0, dtype=np.int32)
                taken = np.clip(left[cut] - (upto[y] - own[y]), 0, own[y])
                out[4 + i, c.start + cut] = taken.sum(axis=0)
    return out


def replicate_metrics(
    rows: DataFrame,
    names: DataFrame,
    n_draws: int,
    seed: int,
    limits: Sequence[tuple[float, int | None]],
    clip: float,
) -> DataFrame:
    """(_k, side, draw, n, n_positive, event_rate, auroc, auprc, brier, logloss, k_i, events_i …) per group and replicate.

    ``rows`` has the group in ``_k`` and ``side`` (numbers), the score ``_s``, the label ``_y``, the unit's number ``_i`` and its
    corrections ``_fix``, and ``_h``, 16 bytes that order equal scores; ``names`` has the groups' texts and numbers of units
    (``_k, _name, _n``). ``limits`` are (fraction, percent or None).
    """
    width = n_draws + 1
    blocks = _blocks(rows, max(1, CELLS // width))
    named = lookup_join(blocks, names, ["_k"], at_hand=True)
    tasks = wide_partitions(rows)
    heads = _heads(_edges(named, n_draws, seed), clip)
    totals = heads.where("seq is null").select("_k", "side", F.col("head_pos").alias("all_pos"), F.col("head_neg").alias("all_neg"))
    before = heads.where("seq is not null").select(*_BLOCK, "runs", "head_pos", "head_neg", "pos", "neg")
    opened = _opened(lookup_join(before, totals, ["_k", "side"], at_hand=True), limits, n_draws)
    met = lookup_join(named, opened.where("seq is not null").drop("terms"), _BLOCK, at_hand=True)
    met = lookup_join(met, totals, ["_k", "side"], at_hand=True).repartition(tasks, *_BLOCK)
    extra = len(limits)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                key = (row["_k"], row["side"])
                sums[key] = sums.get(key, 0) + _block_terms(row, limits, clip, n_draws, seed)
        for (k, side), found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([side], pa.int32()), pa.array([_vector(found)], pa.binary())], ["_k", "side", "terms"])

    parts = met.mapInArrow(terms, "_k int, side int, terms binary").unionByName(opened.where("seq is null").select("_k", "side", "terms"))
    ends = heads.where("seq is null").select("_k", "side", F.lit(None).cast("binary").alias("terms"), "head_pos", "head_neg", *_END)
    names = ["_k", "side", "draw", "n", "n_positive", "event_rate", "auroc", "auprc", "brier", "logloss"]
    names += [f"{c}_{i}" for i in range(extra) for c in ("k", "events")]

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, end = {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["_k"], row["side"])
                if row["terms"] is None:
                    end[key] = {c: _numbers(row[c]) for c in ("head_pos", "head_neg", *_END)}
                else:
                    sums[key] = sums.get(key, 0) + _numbers(row["terms"]).reshape(4 + extra, width)
        for key, last in end.items():
            pos, neg = last["head_pos"], last["head_neg"]
            found = sums.get(key, 0) + np.concatenate([[last[c] for c in _END], np.zeros((extra, width))])
            n, two = pos + neg, (pos > 0) & (neg > 0)
            area = np.divide(found[0], pos * neg, out=np.zeros(width), where=two)
            precision = np.divide(found[1], pos, out=np.zeros(width), where=two)
            columns = [pa.array(np.full(width, x, np.int32)) for x in key] + [pa.array(np.arange(width, dtype=np.int32))]
            columns += [pa.array(x.astype(np.int64)) for x in (n, pos)] + [pa.array(pos / n)]
            columns += [pa.array(x, mask=~two) for x in (area, precision)] + [pa.array(found[2] / n), pa.array(found[3] / n)]
            for i, top in enumerate(_top_sizes(n, limits)):
                columns += [pa.array(top.astype(np.int64)), pa.array(found[4 + i].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ["int", "int", "int", "long", "long", *["double"] * 5, *["long"] * (2 * extra)]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, kinds))
    gathered = reduce(lambda a, b: a.unionByName(b, True), [ends, parts]).repartition("_k", "side")
    return gathered.mapInArrow(finished, schema)
