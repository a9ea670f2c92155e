"""Histogram trees: leaf-wise gradient boosting and balanced random forests on numbers with gaps.

Values become bins, the last of which is for missing ones. Every step is one aggregate of sums per (node, feature, bin)
for all nodes that may be split next; what comes back to the driver is the best split per node. Boosted trees grow by the
best leaf first: of the leaves with the highest known gains, as many as splits are left, all are opened in one step,
because no other leaf can still be chosen. Forests draw their row counts per tree from the same
tree of binomials as the bootstrap and balance the classes per tree.

A training table of bounded size is fitted inside tasks, with the same steps in memory; a larger one stays spread out.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrisk.operators.filters import union_tables
from seqrisk.plans.joins import release, stored
from seqrisk.plans.ordered import GROUP, dense_index, hash_text, never_null
from seqrisk.plans.replicates import LEAF, leaf_weights

# These functions travel to the executors by value, so that they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS, MISSING = 256, 255
#: Rows times features of a training table that a task may hold.
CELLS = 1 << 25
#: How many times as many bins, a byte each, take the same room.
BYTES = 8
#: (node, feature) sums of one step.
STEP = 4096
#: Trees after which scores of training rows are stored again.
AGAIN = 10
LEAST_HESSIAN = 1e-3
#: Numbers of kept sums of open nodes in a task (64 MB); nodes beyond are counted anew.
KEPT = 1 << 23
#: Rows of a node up to which the features are counted in one call.
SHORT = 1024
#: Gains that differ by less than this part of their scale are equal: sums depend on the order of the rows.
EQUAL = 1e-10
#: Tasks that share the trees of a forest.
CHUNKS = 16

Split = tuple[float, int, int, bool, float, float, float, float]  # gain, feature, bin, missing left, sums G and H on both sides


@dataclass
class Tree:
    """Nodes by number, 0 the root; ``feature`` -1 is a leaf with a ``value``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, split: Split, values: tuple[float, float]) -> tuple[int, int]:
        _, self.feature[node], self.bin[node], self.missing_left[node] = split[:4]
        for value in values:
            for held, filled in zip((self.feature, self.bin, self.missing_left, self.left, self.right), (-1, 0, False, 0, 0)):
                held.append(filled)
            self.value.append(value)
            self.depth.append(self.depth[node] + 1)
        self.left[node], self.right[node] = len(self.feature) - 2, len(self.feature) - 1
        return self.left[node], self.right[node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Node of each row of bins."""
        feature, cut, gap, left, right = map(np.array, (self.feature, self.bin, self.missing_left, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            rows = rows[feature[at[rows]] >= 0]
            if not len(rows):
                return at
            node = at[rows]
            own = bins[rows, feature[node]]
            at[rows] = np.where(np.where(own == MISSING, gap[node], own <= cut[node]), left[node], right[node])

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


def bin_values(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many cuts are below it; missing values have their own."""
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(c, x[:, j], "left"))
    return out


def cuts_of(values: np.ndarray) -> np.ndarray:
    """Cuts between all distinct values, or at equally filled quantiles if there are too many."""
    known = values[~np.isnan(values)]
    distinct = np.unique(known)
    if len(distinct) <= MISSING:
        return (distinct[1:] + distinct[:-1]) / 2
    return np.unique(np.quantile(known, np.arange(1, MISSING) / MISSING, method="lower"))


def gains_of(sums: np.ndarray, leaf: int, l2: float, least: float) -> tuple[np.ndarray, ...]:
    """Per feature its best split from its sums, ([G, H, rows], features, BINS); the first among equals.

    Whether there is one, its gain, bin, side of the missing values, and G, H of the left and of the right.
    """
    total, gaps = sums.sum(axis=2), sums[:, :, MISSING]
    low = np.cumsum(sums[:, :, : MISSING - 1], axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = np.nan_to_num(total[0] ** 2 / (total[1] + l2))
    scale = EQUAL * (1 + whole)
    best = scale.copy()  # a gain below is rounding
    every = np.arange(sums.shape[1])
    found, bins, toward, sides = np.zeros(len(every), bool), np.zeros(len(every), int), np.zeros(len(every), bool), np.zeros((4, len(every)))
    for missing_left in (False, True) if gaps[2].any() else (False,):
        left = low + gaps[:, :, None] if missing_left else low
        right = total[:, :, None] - left
        fits = (left[2] >= leaf) & (right[2] >= leaf) & (left[1] >= least) & (right[1] >= least)
        if not fits.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / (left[1] + l2)
            gain += right[0] ** 2 / (right[1] + l2)
        gain -= whole[:, None]
        gain[~fits] = -1.0
        top = gain.max(axis=1)
        at = (gain >= (top - scale)[:, None]).argmax(axis=1)
        more = top > best + scale
        j, b = every[more], at[more]
        found[j], bins[j], best[j] = True, b, gain[j, b]
        toward[j] = np.where(gaps[2, j] > 0, missing_left, left[2, j, b] > right[2, j, b])
        sides[:, j] = left[0, j, b], left[1, j, b], right[0, j, b], right[1, j, b]
    return found, best, bins, toward, sides


def _split_of(j: int, best: np.ndarray, bins: np.ndarray, toward: np.ndarray, sides: np.ndarray) -> Split:
    return (float(best[j]), int(j), int(bins[j]), bool(toward[j]), *map(float, sides[:, j]))


def best_of(sums: np.ndarray, leaf: int, l2: float, least: float) -> list[Split | None]:
    """``gains_of`` as one split, or none, per feature."""
    found, *rest = gains_of(sums, leaf, l2, least)
    return [_split_of(j, *rest) if known else None for j, known in enumerate(found)]


def sums_of(bins: np.ndarray, g: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """([G, H, rows], features, BINS) of some rows."""
    width = bins.shape[1]
    at = (bins.astype(np.int64) + np.arange(width) * BINS).ravel()
    each = [np.bincount(at, np.repeat(v, width), width * BINS) for v in (g, h, c)]
    return np.stack(each).reshape(3, width, BINS)


def sums_of_counted(columns: np.ndarray, features: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``sums_of`` of the rows ``at`` of a table of bins by feature, each row counted once."""
    g, h, width = g[at], h[at], len(features)
    out = np.empty((3, width, BINS))
    if len(at) < SHORT:  # one call for all features
        own = (columns[np.ix_(features, at)] + np.arange(width)[:, None] * BINS).ravel()
        for n, v in enumerate((g, h, None)):
            out[n] = np.bincount(own, None if v is None else np.tile(v, width), width * BINS).reshape(width, BINS)
        return out
    for j, feature in enumerate(features):
        own = columns[feature, at].astype(np.intp)
        out[0, j], out[1, j], out[2, j] = np.bincount(own, g, BINS), np.bincount(own, h, BINS), np.bincount(own, minlength=BINS)
    return out


@dataclass
class Want:
    """A node whose best split is asked for, among some features (None: all)."""

    tree: int
    node: int
    features: np.ndarray | None = None


def _pick(found: list[Split | None], features: np.ndarray | None) -> Split | None:
    """The best feature's split, the first among equals, with its number in the whole table."""
    best = None
    for split in found:
        if split and (best is None or split[0] > best[0] * (1 + EQUAL) + EQUAL):
            best = split
    if best and features is not None:
        best = (best[0], int(features[best[1]]), *best[2:])
    return best


def _best_feature(found: np.ndarray, best: np.ndarray, *rest: np.ndarray, features: np.ndarray | None) -> Split | None:
    """``_pick`` from ``gains_of``."""
    top = None
    for j in np.flatnonzero(found):
        if top is None or best[j] > best[top] * (1 + EQUAL) + EQUAL:
            top = j
    return None if top is None else _pick([_split_of(top, best, *rest)], features)


# ---------------------------------------------------------------- growing, wherever the rows are


class LocalRows:
    """Rows in memory: gradients per tree, and the rows of every open node.

    Where all features are asked for, the sums of a node are kept until its children are known: those of the child
    with more rows are the parent's less the other child's.
    """

    def __init__(self, bins: np.ndarray, leaf: int, l2: float, least: float):
        self.columns, self.rule = np.ascontiguousarray(bins.T), (leaf, l2, least)
        self.sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.rows: dict[tuple[int, int], np.ndarray] = {}
        self.kept: dict[tuple[int, int], np.ndarray] = {}
        self.kin: dict[tuple[int, int], tuple[tuple[int, int], tuple[int, int]]] = {}
        self.most = KEPT // max(1, 3 * BINS * bins.shape[1])

    def start(self, tree: int, g: np.ndarray, h: np.ndarray, c: np.ndarray) -> None:
        self.sums[tree], self.rows[tree, 0] = (g, h, c), np.flatnonzero(c)

    def totals(self, tree: int) -> tuple[float, float]:
        g, h, _ = self.sums[tree]
        return float(g.sum()), float(h.sum())

    def counted(self, key: tuple[int, int], features: np.ndarray | None = None) -> np.ndarray:
        """Sums of a node from its rows."""
        g, h, _ = self.sums[key[0]]
        return sums_of_counted(self.columns, np.arange(len(self.columns)) if features is None else features, self.rows[key], g, h)

    def whole(self, key: tuple[int, int]) -> np.ndarray:
        """Sums of a node over all features."""
        if key in self.kept:
            return self.kept[key]
        parent, other = self.kin.get(key, (None, None))
        if parent not in self.kept or len(self.kept) >= self.most:
            found = {key: self.counted(key)}
        else:
            few, many = sorted((key, other), key=lambda k: len(self.rows[k]))
            found = {few: self.counted(few)}
            found[many] = self.kept.pop(parent) - found[few]
        if len(self.kept) < self.most:
            self.kept.update(found)
        return found[key]

    def best(self, wants: list[Want]) -> list[Split | None]:
        out = []
        for want in wants:
            key = want.tree, want.node
            split = None
            if len(self.rows[key]) >= 2 * self.rule[0]:
                sums = self.whole(key) if want.features is None else self.counted(key, want.features)
                split = _best_feature(*gains_of(sums, *self.rule), features=want.features)
            if not split:
                self.kept.pop(key, None)
            out.append(split)
        return out

    def opened(self, tree: int, shape: Tree, node: int) -> None:
        at = self.rows.pop((tree, node))
        own = self.columns[shape.feature[node], at]
        low = np.where(own == MISSING, shape.missing_left[node], own <= shape.bin[node])
        left, right = (tree, shape.left[node]), (tree, shape.right[node])
        self.rows[left], self.rows[right] = at[low], at[~low]
        self.kin[left], self.kin[right] = ((tree, node), right), ((tree, node), left)

    def finish(self, tree: int) -> None:
        self.sums.pop(tree)
        for table in (self.rows, self.kept, self.kin):
            for key in [k for k in table if k[0] == tree]:
                del table[key]


def grow_best_first(rows, tree: int, leaves: int, rate: float, l2: float) -> Tree:
    """A tree of at most ``leaves`` leaves, the leaf of the highest gain split first.

    Splits are opened ahead: of the known leaves only as many as splits are left can still be chosen, and all of
    them are opened in one step, each with its children's best splits; the order is settled at the end.
    """
    shape = Tree()
    splits = {0: rows.best([Want(tree, 0)])[0]}
    if not splits[0]:
        g, h = rows.totals(tree)
        shape.value[0] = -rate * g / (h + l2)
    children: dict[int, tuple[int, int]] = {}

    def chosen() -> tuple[list[int], list[int]]:
        """Nodes split so far in order, and leaves that would come next but are not open yet."""
        order, known, ahead = [], [0], []
        while known and len(order) + len(ahead) < leaves - 1:
            known = [n for n in known if splits[n]]
            if not known:
                break
            top = max(known, key=lambda n: (splits[n][0], -n))
            known.remove(top)
            if top in children:
                order.append(top)
                known += children[top]
            else:
                ahead.append(top)
        return order, ahead

    while True:
        order, ahead = chosen()
        if not ahead:
            break
        for node in ahead:
            split = splits[node]
            values = tuple(-rate * split[i] / (split[i + 1] + l2) for i in (4, 6))
            children[node] = shape.split(node, split, values)
            rows.opened(tree, shape, node)
        fresh = [c for node in ahead for c in children[node]]
        splits.update(zip(fresh, rows.best([Want(tree, n) for n in fresh])))
    rows.finish(tree)
    return _kept(shape, set(order))


def _kept(shape: Tree, split: set[int]) -> Tree:
    """The tree whose only splits are those."""
    out = Tree(value=[shape.value[0]])
    waiting = [(0, 0)]
    while waiting:
        old, new = waiting.pop()
        if old in split:
            cut = (0.0, shape.feature[old], shape.bin[old], shape.missing_left[old], 0.0, 0.0, 0.0, 0.0)
            both = (shape.left[old], shape.right[old])
            waiting += zip(both, out.split(new, cut, tuple(shape.value[c] for c in both)))
    return out


def grow_level_by_level(rows, roots: Mapping[int, tuple[float, float]], depth: int, width: int, seed: int) -> dict[int, Tree]:
    """Trees of a forest together; each node tries the square root of the features, chosen by its number."""
    many = max(1, int(math.sqrt(width)))
    shapes = {t: Tree(value=[g / h if h else 0.0]) for t, (g, h) in roots.items()}

    def want(tree: int, node: int) -> Want:
        order = np.random.default_rng([seed & 0xFFFFFFFF, tree, node]).permutation(width)
        return Want(tree, node, np.sort(order[:many]))

    wants = [want(t, 0) for t in shapes]
    while wants:
        following = []
        for asked, split in zip(wants, rows.best(wants)):
            if split:
                shape = shapes[asked.tree]
                both = shape.split(asked.node, split, (split[4] / split[5], split[6] / split[7]))
                rows.opened(asked.tree, shape, asked.node)
                if shape.depth[both[0]] < depth:
                    following += [want(asked.tree, n) for n in both]
        wants = following
    for t in shapes:
        rows.finish(t)
    return shapes


def _sigmoid(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-raw))


def boost(bins: np.ndarray, y: np.ndarray, w: np.ndarray, config: Mapping) -> tuple[float, list[Tree]]:
    """First score and trees of a boosted model on rows in memory."""
    start = _start(float(w[y == 1].sum()), float(w[y == 0].sum()))
    raw = np.full(len(y), start)
    rows = LocalRows(bins, config["leaf"], config["l2"], LEAST_HESSIAN)
    trees = []
    for t in range(config["rounds"]):
        p = _sigmoid(raw)
        rows.start(t, (p - y) * w, p * (1 - p) * w, np.ones(len(y)))
        trees.append(grow_best_first(rows, t, config["leaves"], config["rate"], config["l2"]))
        raw += trees[-1].values(bins)
    return start, trees


def _start(positive: float, negative: float) -> float:
    if not positive or not negative:
        raise ValueError("The training rows have one class only")
    return math.log(positive / negative)


def class_weights(counts: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weights of class 0 and 1 that balance a tree's drawn rows; a class that was not drawn has none."""
    total, positive = float(counts.sum()), float(counts[y == 1].sum())
    both = (total - positive, positive)
    return tuple(total / (sum(x > 0 for x in both) * x) if x else 0.0 for x in both)


def forest(bins: np.ndarray, y: np.ndarray, config: Mapping, seed: int, balanced: bool, first: int, last: int) -> list[Tree]:
    """Trees ``first`` to before ``last`` of a forest on rows in memory, in the order of their numbers."""
    n = len(y)
    drawn = np.concatenate([leaf_weights("forest", seed, n, k, config["trees"])[:, first + 1 : last + 1] for k in range(-(-n // LEAF))])
    rows = LocalRows(bins, config["leaf"], 0.0, 1e-12)
    out = []
    for t in range(first, last):
        counts = drawn[:, t - first].astype(float)
        weights = class_weights(counts, y) if balanced else (1.0, 1.0)
        w = counts * np.where(y == 1, weights[1], weights[0])
        rows.start(t, w * y, w, (counts > 0).astype(float))
        out.append(grow_level_by_level(rows, {t: rows.totals(t)}, config["depth"], bins.shape[1], seed)[t])
    return out


# ---------------------------------------------------------------- rows spread over tasks


def spread_cuts(df: DataFrame, column: str, use: Sequence[int], fill: Sequence[float] | None = None) -> list[np.ndarray]:
    """Cuts of some places of an array: distinct values from the tasks where there are few, else approximate quantiles."""
    width = len(use)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * width
        for batch in batches:
            x = _matrix(batch.column(0), use, fill)
            for j in range(width):
                if len(seen[j]) <= MISSING:
                    seen[j] = np.unique(np.concatenate([seen[j], x[~np.isnan(x[:, j]), j]]))[: MISSING + 1]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([s.tolist() for s in seen], pa.list_(pa.float64()))], ["j", "v"])

    lists = df.select(column).mapInArrow(run, "j int, v array<double>")
    found = {r["j"]: np.array(r["v"]) for r in lists.groupBy("j").agg(F.array_distinct(F.flatten(F.collect_list("v"))).alias("v")).collect()}
    many = [j for j in range(width) if len(found.get(j, ())) > MISSING]
    cuts = {}
    if many:
        ends = F.array(*[F.lit(i / MISSING) for i in range(1, MISSING)])
        value = {j: F.coalesce(F.get(column, F.lit(use[j])), F.lit(None if fill is None else fill[j]).cast("double")) for j in many}
        row = df.agg(*[F.percentile_approx(value[j], ends, F.lit(10_000)).alias(f"q{j}") for j in many]).first()
        cuts = {j: np.unique(np.array(row[f"q{j}"], float)) for j in many}
    return [cuts[j] if j in cuts else cuts_of(found.get(j, np.zeros(0))) for j in range(width)]


class SpreadRows:
    """Rows in a stored table (``_i``, ``y``, ``w``, ``bins``, ``raw``); sums come back per node and feature.

    ``weights`` gives (G, H, rows) of each tree in hand from a batch's arrays; it travels to the tasks.
    """

    def __init__(self, table: DataFrame, width: int, rule: tuple[int, float, float], weights):
        self.table, self.width, self.rule, self.weights = table, width, rule, weights
        self.shapes: dict[int, Tree] = {}

    def opened(self, tree: int, shape: Tree, node: int) -> None:
        self.shapes[tree] = shape

    def finish(self, tree: int) -> None:
        self.shapes.pop(tree, None)

    def totals(self, tree: int) -> tuple[float, float]:
        weights, width = self.weights, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g, h, _ = weights(tree, _arrays(batch, width))
                yield pa.RecordBatch.from_arrays([pa.array([g.sum()]), pa.array([h.sum()])], ["g", "h"])

        return tuple(self.table.mapInArrow(run, "g double, h double").agg(F.sum("g"), F.sum("h")).first())

    def best(self, wants: list[Want]) -> list[Split | None]:
        out, at = [], 0
        while at < len(wants):
            each = self.width if wants[at].features is None else len(wants[at].features)
            some = wants[at : at + max(1, STEP // each)]
            out += self._step(some)
            at += len(some)
        return out

    def _step(self, wants: list[Want]) -> list[Split | None]:
        shapes, weights, rule, width = self.shapes, self.weights, self.rule, self.width
        by_tree: dict[int, list[tuple[int, Want]]] = {}
        for n, want in enumerate(wants):
            by_tree.setdefault(want.tree, []).append((n, want))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                rows = _arrays(batch, width)
                for tree, asked in by_tree.items():
                    g, h, c = weights(tree, rows)
                    at = shapes[tree].leaves(rows["bins"]) if tree in shapes else np.zeros(len(g), int)
                    for n, want in asked:
                        mine = np.flatnonzero((at == want.node) & (c > 0))
                        if len(mine):
                            bins = rows["bins"][mine] if want.features is None else rows["bins"][np.ix_(mine, want.features)]
                            sums[n] = sums.get(n, 0) + sums_of(bins, g[mine], h[mine], c[mine])
            for n, found in sums.items():
                each = found.shape[1]
                kinds = [pa.array(np.full(each, n, np.int32)), pa.array(np.arange(each, dtype=np.int32)), pa.array([found[:, j].tobytes() for j in range(each)], pa.binary())]
                yield pa.RecordBatch.from_arrays(kinds, ["n", "j", "sums"])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for n, j, part in zip(*(c.to_pylist() for c in batch.columns)):
                    sums[n, j] = sums.get((n, j), 0) + np.frombuffer(part).reshape(3, 1, BINS)
            for (n, j), found in sums.items():
                split = best_of(found, *rule)[0]
                if split:
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([j], pa.int32()), pa.array([pickle.dumps(split)], pa.binary())], ["n", "j", "split"])

        parts = self.table.mapInArrow(partial, "n int, j int, sums binary").repartition("n", "j")
        found: list[list] = [[] for _ in wants]
        for r in sorted(parts.mapInArrow(whole, "n int, j int, split binary").collect(), key=lambda r: (r["n"], r["j"])):
            split = pickle.loads(r["split"])
            found[r["n"]].append((split[0], r["j"], *split[2:]))
        return [_pick(f, want.features) for f, want in zip(found, wants)]


def _arrays(batch: pa.RecordBatch, width: int) -> dict[str, np.ndarray]:
    out = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names) if n != "bins"}
    out["bins"] = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, width)
    return out


def _binned(df: DataFrame, column: str, use: Sequence[int], fill: Sequence[float] | None, cuts: list[np.ndarray]) -> DataFrame:
    """(_i, y, w, bins, raw) of a training table with ``_i``, ``y``, ``w`` and the array, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(3), use, fill)
            bins = pa.array([b.tobytes() for b in bin_values(x, cuts)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], bins, pa.array(np.zeros(len(x)))], ["_i", "y", "w", "bins", "raw"])

    return stored(df.select("_i", "y", "w", column).mapInArrow(run, "_i long, y int, w double, bins binary, raw double"))


def _matrix(column: pa.Array, use: Sequence[int], fill: Sequence[float] | None) -> np.ndarray:
    """Some places of an array column as rows of numbers, NaN where they are missing and not filled."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)[:, list(use)]
    return x if fill is None else np.where(np.isnan(x), np.array(fill), x)


def _spread_boost(table: DataFrame, width: int, config: Mapping) -> tuple[float, list[Tree]]:
    by = table.agg(F.sum(F.when(F.col("y") == 1, F.col("w"))), F.sum(F.when(F.col("y") == 0, F.col("w")))).first()
    start = _start(by[0] or 0.0, by[1] or 0.0)
    trees: list[Tree] = []
    fresh: list[Tree] = []

    def raw_now(rows: dict, newer: list[Tree]) -> np.ndarray:
        return rows["raw"] + sum(t.values(rows["bins"]) for t in newer)

    for t in range(config["rounds"]):
        newer = list(fresh)

        def weights(tree: int, rows: dict, newer=newer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            p = _sigmoid(start + raw_now(rows, newer))
            return (p - rows["y"]) * rows["w"], p * (1 - p) * rows["w"], np.ones(len(p))

        rows = SpreadRows(table, width, (config["leaf"], config["l2"], LEAST_HESSIAN), weights)
        trees.append(grow_best_first(rows, t, config["leaves"], config["rate"], config["l2"]))
        fresh.append(trees[-1])
        if len(fresh) == AGAIN:
            newer = list(fresh)

            def on(batches: Iterator[pa.RecordBatch], newer=newer) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    raw = raw_now(_arrays(batch, width), newer)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(raw)], batch.schema.names)

            before, table = table, stored(table.mapInArrow(on, table.schema))
            release(before)
            fresh = []
    release(table)
    return start, trees


def _spread_forest(table: DataFrame, width: int, config: Mapping, seed: int, balanced: bool, n: int) -> list[Tree]:
    trees, many = config["trees"], max(1, STEP // (4 * max(1, int(math.sqrt(width)))))

    def counts(rows: dict, first: int, last: int) -> np.ndarray:
        out = np.zeros((len(rows["_i"]), last - first))
        for leaf in np.unique(rows["_i"] // LEAF):
            at = rows["_i"] // LEAF == leaf
            out[at] = leaf_weights("forest", seed, n, int(leaf), trees)[rows["_i"][at] % LEAF, first + 1 : last + 1]
        return out

    found = []
    for first in range(0, trees, many):
        last = min(trees, first + many)

        def drawn(batches: Iterator[pa.RecordBatch], first=first, last=last) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, last - first))
            for batch in batches:
                rows = _arrays(batch, width)
                c = counts(rows, first, last)
                sums += np.stack([c[rows["y"] == k].sum(axis=0) for k in (0, 1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last)), *map(pa.array, sums)], ["t", "n0", "n1"])

        totals = table.mapInArrow(drawn, "t long, n0 double, n1 double").groupBy("t").agg(F.sum("n0"), F.sum("n1")).collect()
        balance, roots = {}, {}
        for t, negative, positive in totals:
            pair = class_weights(np.array([negative, positive]), np.array([0, 1])) if balanced else (1.0, 1.0)
            balance[t] = pair
            roots[t] = (positive * pair[1], positive * pair[1] + negative * pair[0])

        def weights(tree: int, rows: dict, balance=balance, first=first, last=last) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if "counts" not in rows:
                rows["counts"] = counts(rows, first, last)
            c = rows["counts"][:, tree - first]
            w = c * np.where(rows["y"] == 1, balance[tree][1], balance[tree][0])
            return w * rows["y"], w, (c > 0).astype(float)

        spread = SpreadRows(table, width, (config["leaf"], 0.0, 1e-12), weights)
        grown = grow_level_by_level(spread, roots, config["depth"], width, seed)
        found += [grown[t] for t in range(first, last)]
    release(table)
    return found


# ---------------------------------------------------------------- fit and predict


@dataclass
class Model:
    """A fitted model: cuts per feature, trees, and the score before the first (None: trees are averaged)."""

    cuts: list[np.ndarray]
    trees: list[Tree]
    start: float | None

    def risk(self, x: np.ndarray) -> np.ndarray:
        return self.binned_risk(bin_values(x, self.cuts))

    def binned_risk(self, bins: np.ndarray) -> np.ndarray:
        total = sum((t.values(bins) for t in self.trees), np.zeros(len(bins)))
        return _sigmoid(self.start + total) if self.start is not None else total / len(self.trees)


def exact_cuts(df: DataFrame, column: str, use: Sequence[int], fill: Sequence[float]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """``cuts_of`` some places of an array, with missing numbers left out and filled. A place's numbers meet in a task, eight bytes a row."""
    width = len(use)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ascontiguousarray(_matrix(batch.column(0), use, None).T)
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], ["j", "v"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for j, v in zip(*(c.to_pylist() for c in batch.columns)):
                parts.setdefault(j, []).append(v)
        for j in list(parts):
            x = np.frombuffer(b"".join(parts.pop(j)))
            both = cuts_of(x), cuts_of(np.where(np.isnan(x), fill[j], x))
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), *(pa.array([c.tolist()], pa.list_(pa.float64())) for c in both)], ["j", "known", "filled"])

    parts = df.select(column).mapInArrow(run, "j int, v binary").repartition(max(1, width), "j")
    rows = {r["j"]: r for r in parts.mapInArrow(found, "j int, known array<double>, filled array<double>").collect()}
    return tuple([np.array(rows[j][kind] if j in rows else [], float) for j in range(width)] for kind in ("known", "filled"))


@dataclass
class Bins:
    """Stored rows as bins of some places of an array, a byte each: training rows (``_i``, ``y``, ``w``) and others, with their cuts.

    ``bins`` has missing numbers in a bin of their own, ``filled`` has them filled; ``cuts`` are by these names.
    """

    train: DataFrame
    others: DataFrame
    use: list[int]
    cuts: dict[str, list[np.ndarray]]


def binned_rows(train: DataFrame, others: DataFrame, column: str, use: Sequence[int], fill: Sequence[float], weight: Column | None = None) -> Bins:
    """``Bins`` of two tables with ``row_id``, ``y_true`` and an array; numbers of rows are as in ``fit_trees``."""
    use, fill = list(use), [float(v) for v in fill]
    both = exact_cuts(train, column, use, fill)

    def on(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c != column]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(len(keep)), use, None)
                sides = (bin_values(x, both[0]), bin_values(np.where(np.isnan(x), np.array(fill), x), both[1]))
                binary = [pa.array([row.tobytes() for row in side], pa.binary()) for side in sides]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *binary], [*keep, "bins", "filled"])

        return df.select(*keep, column).mapInArrow(run, df.select(*keep).schema.add("bins", "binary").add("filled", "binary"))

    base = _training(train, column, weight)
    listed = on(base).select(F.struct(F.lit(0)).alias(GROUP), "*")
    numbered = dense_index(listed, [F.asc("_h"), F.asc("row_id")], F.substring("_h", 1, 3), "_i").select("_i", "y", "w", "bins", "filled")
    return Bins(stored(numbered), stored(on(others)), use, dict(zip(("bins", "filled"), both)))


def _training(train: DataFrame, column: str, weight: Column | None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return train.select(
        never_null(hash_text(F.col("row_id")), F.lit("")).alias("_h"), "row_id", F.col("y_true").cast("int").alias("y"), w.cast("double").alias("w"), column
    )


def fit_bins(table: Bins, use: Sequence[int], config: Mapping, seed: int, balanced: bool = False) -> Model:
    """``fit_trees`` on binned training rows inside tasks: a boosted model in one, a forest in ``CHUNKS`` that each read all rows."""
    chunks = min(CHUNKS, config["trees"]) if config["kind"] == "forest" else 1
    name = "filled" if "fill" in config else "bins"
    at = [table.use.index(i) for i in use]
    cuts = [table.cuts[name][j] for j in at]
    width = len(table.use)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        k = held[0].column(4)[0].as_py()
        order = np.argsort(np.concatenate([b.column(0).to_numpy() for b in held]))
        y, w = (np.concatenate([b.column(i).to_numpy() for b in held])[order] for i in (1, 2))
        bins = np.concatenate([np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, width)[:, at] for b in held])[order]
        del held
        if config["kind"] == "boosted":
            made = Model([], *reversed(boost(bins, y, w, config)))
        else:
            ends = [round(config["trees"] * i / chunks) for i in (k, k + 1)]
            made = Model([], forest(bins, y, config, seed, balanced, *ends), None)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps(_plain(made))], pa.binary())], ["k", "model"])

    rows = table.train.select("_i", "y", "w", name)
    dealt = [rows.coalesce(1).withColumn("_chunk", F.lit(k)).mapInArrow(run, "k int, model binary") for k in range(chunks)]
    models = [_whole(pickle.loads(r["model"])) for r in sorted(union_tables(*dealt).collect())]
    if not models:
        raise ValueError("No training rows")
    return Model(cuts, [t for m in models for t in m.trees], models[0].start)


def bins_risk(table: Bins, use: Sequence[int], config: Mapping, model: Model) -> DataFrame:
    """The other rows of ``table`` without bins but with ``risk``."""
    keep, name = [c for c in table.others.columns if c not in ("bins", "filled")], "filled" if "fill" in config else "bins"
    at, width = [table.use.index(i) for i in use], len(table.use)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(len(keep)).to_pylist()), np.uint8).reshape(-1, width)[:, at]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(model.binned_risk(bins))], [*keep, "risk"])

    return table.others.select(*keep, name).mapInArrow(run, table.others.select(*keep).schema.add("risk", "double"))


def fit_trees(
    train: DataFrame,
    column: str,
    use: Sequence[int],
    config: Mapping,
    seed: int,
    balanced: bool = False,
    weight: Column | None = None,
    fill: Sequence[float] | None = None,
    n_rows: int | None = None,
    cells: int = CELLS,
) -> Model:
    """Fit on ``train`` (row_id, y_true and an array of numbers, NULL where missing), on some places of the array.

    ``config`` kind ``boosted``: rounds, rate, leaves, leaf (rows), l2; rows weigh ``weight``. Kind ``forest``: trees, depth,
    leaf; ``balanced`` weighs the classes per tree. ``fill`` has a number per place to take for a missing one. Rows are numbered
    by a hash of their id, so draws do not depend on how they lie.
    """
    use = list(use)
    base = _training(train, column, weight)
    n = train.count() if n_rows is None else n_rows
    if n * len(use) <= cells:
        return _fit_in_tasks(base, column, use, config, seed, balanced, fill)
    listed = base.select(F.struct(F.lit(0)).alias(GROUP), "*")
    numbered = stored(dense_index(listed, [F.asc("_h"), F.asc("row_id")], F.substring("_h", 1, 3), "_i").select("_i", "y", "w", column))
    cuts = spread_cuts(numbered, column, use, fill)
    table = _binned(numbered, column, use, fill, cuts)
    release(numbered)
    if config["kind"] == "boosted":
        start, trees = _spread_boost(table, len(use), config)
    else:
        start, trees = None, _spread_forest(table, len(use), config, seed, balanced, n)
    return Model(cuts, trees, start)


def _fit_in_tasks(rows: DataFrame, column: str, use: list[int], config: Mapping, seed: int, balanced: bool, fill: Sequence[float] | None) -> Model:
    """A boosted model in one task, a forest in ``CHUNKS`` that have all rows and some of the trees."""
    chunks = min(CHUNKS, config["trees"]) if config["kind"] == "forest" else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        for k in sorted(set(table.column("_chunk").to_pylist())):
            own = table.filter(pc.equal(table.column("_chunk"), k)).sort_by([("_h", "ascending"), ("row_id", "ascending")])
            y, w = own.column("y").to_numpy(), own.column("w").to_numpy()
            x = np.concatenate([_matrix(part, use, fill) for part in own.column(column).chunks])
            cuts = [cuts_of(x[:, j]) for j in range(x.shape[1])]
            bins = bin_values(x, cuts)
            if config["kind"] == "boosted":
                start, trees = boost(bins, y, w, config)
                made = Model(cuts, trees, start)
            else:
                ends = [round(config["trees"] * i / chunks) for i in (k, k + 1)]
                made = Model(cuts, forest(bins, y, config, seed, balanced, *ends), None)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps(_plain(made))], pa.binary())], ["k", "model"])

    spread = rows.withColumn("_chunk", F.explode(F.array(*map(F.lit, range(chunks)))))
    dealt = spread.repartition(chunks, "_chunk") if chunks > 1 else spread.coalesce(1)
    parts = sorted(dealt.mapInArrow(run, "k int, model binary").collect())
    models = [_whole(pickle.loads(r["model"])) for r in parts]
    if not models:
        raise ValueError("No training rows")
    return Model(models[0].cuts, [t for m in models for t in m.trees], models[0].start)


def _plain(model: Model) -> tuple:
    return [c.tolist() for c in model.cuts], [vars(t) for t in model.trees], model.start


def _whole(parts: tuple) -> Model:
    return Model([np.array(c) for c in parts[0]], [Tree(**t) for t in parts[1]], parts[2])


def tree_risk(rows: DataFrame, column: str, use: Sequence[int], model: Model, fill: Sequence[float] | None = None) -> DataFrame:
    """``rows`` without the array but with ``risk``, row by row."""
    keep, use = [c for c in rows.columns if c != column], list(use)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            risk = model.risk(_matrix(batch.column(len(keep)), use, fill))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(risk)], [*keep, "risk"])

    return rows.select(*keep, column).mapInArrow(run, rows.select(*keep).schema.add("risk", "double"))
