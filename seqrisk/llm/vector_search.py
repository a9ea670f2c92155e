"""Nearest neighbours with a hierarchical k-means tree and best-bin-first traversal."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqrisk.llm.common import tidy
from seqrisk.llm.registry import query, table
from seqrisk.llm.vectors import kmeans, matrix, nearest, per_cell, sound
from seqrisk.plans.joins import lookup_join, stored

#: Vectors of a leaf aimed at, leaves of a tree at most, children of a node, values of the training sample.
LEAF, MOST_LEAVES, BRANCHES, SAMPLE_VALUES = 512, 4096, 8, 4_000_000
#: Vectors or queries of one cell; larger leaves are dealt out as pairs of parts.
PART = 4096
#: Queries of the calibration and the recall that the leaf visits are widened to.
CALIBRATION, RECALL = 128, 0.97


@dataclass
class Tree:
    """Nodes by number: centres, children (none: a leaf), and the leaf's number."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    @staticmethod
    def grown(x: np.ndarray, rows: float) -> Tree:
        """Split by k-means until a node has at most ``rows`` of the sample."""
        tree = Tree()

        def grow(part: np.ndarray, centre: np.ndarray) -> int:
            at = len(tree.centres)
            tree.centres.append(centre)
            tree.children.append([])
            tree.leaf.append(-1)
            k = int(min(BRANCHES, -(-len(part) // max(rows, 1.0))))
            own = np.zeros(0, int)
            if k > 1:
                centres = kmeans(part, k, seed=at)
                own = nearest(part, centres)
            if len(np.unique(own)) > 1:
                tree.children[at] = [grow(part[own == c], centres[c]) for c in np.unique(own)]
            else:
                tree.leaf[at] = tree.leaves
                tree.leaves += 1
            return at

        grow(x, x.mean(axis=0) if len(x) else np.zeros(1))
        return tree

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, down the nearest centres."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if not self.children[at]:
                out[rows] = self.leaf[at]
                continue
            own = nearest(x[rows], np.array([self.centres[c] for c in self.children[at]]))
            todo += [(c, rows[own == n]) for n, c in enumerate(self.children[at]) if (own == n).any()]
        return out

    def visited(self, q: np.ndarray, visits: int, held: np.ndarray | None = None, least: int = 0) -> list[list[int]]:
        """First leaves of each query: the open node with the largest inner product is opened next.

        A query goes on beyond ``visits`` until its leaves hold ``least`` ids, given how many each leaf has (``held``).
        Centres are scored where a node is opened.
        """
        centres = {at: np.array([self.centres[c] for c in self.children[at]]) for at in range(len(self.children)) if self.children[at]}
        out = []
        for row in q:
            heap, found, ids = [(0.0, 0)], [], 0
            while heap and (len(found) < visits or ids < least):
                _, at = heapq.heappop(heap)
                if self.children[at]:
                    for near, c in zip((-(centres[at] @ row)).tolist(), self.children[at]):
                        heapq.heappush(heap, (near, c))
                else:
                    found.append(self.leaf[at])
                    ids += int(held[self.leaf[at]]) if held is not None else 0
            out.append(found)
        return out


def top_products(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the ``k`` largest products of each query, and those products, summed alike for equal vectors."""
    near = q @ x.T
    wide = min(len(x), k + 12)
    pick = np.argpartition(-near, wide - 1, axis=1)[:, :wide] if wide < len(x) else np.broadcast_to(np.arange(len(x)), near.shape)
    return pick, np.einsum("qd,qkd->qk", q, x[pick])


def _grown(vectors: DataFrame) -> tuple[Tree, int]:
    """A tree from a bounded sample of the distinct vectors, and their number."""
    sizes = vectors.agg(F.count(F.lit(1)).alias("n"), F.first(F.size("v")).alias("dim")).first()
    n = sizes["n"]
    rows = min(n, SAMPLE_VALUES // max(1, sizes["dim"] or 1))
    picked = vectors.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < rows / max(n, 1) * (1 << 20))
    x = np.array([r["v"] for r in picked.select("node", "v").orderBy("node").toLocalIterator()]).reshape(-1, sizes["dim"] or 1)
    return Tree.grown(x, max(LEAF, 1.5 * n / MOST_LEAVES) * len(x) / max(n, 1)), n


def _calibrated(index: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaf visits at which a bounded sample of queries finds ``recall`` of its true neighbours, itself not counted."""
    sample = queries.orderBy(F.xxhash64("query_id", F.lit(9)), "query_id").limit(CALIBRATION).collect()
    if not sample:
        return 1
    q, own = np.array([r["v"] for r in sample]), [[r["query_id"]] for r in sample]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int]]] = [[] for _ in range(len(q))]
        for batch in batches:
            x, leaf, ids = matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for at in range(0, len(x), 4096):
                pick, score = top_products(q, x[at : at + 4096], k + 1)
                for i in range(len(q)):
                    others = [(s, int(leaf[at + p])) for s, p in zip(score[i].tolist(), pick[i].tolist()) if ids[at + p] != own[i]]
                    best[i] = heapq.nlargest(k, [*best[i], *others])
        rows = [(i, s, leaf) for i, b in enumerate(best) for s, leaf in b]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["i", "s", "leaf"])

    first = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s")))
    true = index.select("v", "leaf", "ids").mapInArrow(tidy(run), "i long, s double, leaf long").withColumn("_nth", first).where(F.col("_nth") <= k)
    order = [{leaf: n for n, leaf in enumerate(found)} for found in tree.visited(q, tree.leaves)]
    needed = sorted(order[r["i"]][r["leaf"]] + 1 for r in true.select("i", "leaf").collect())
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1


def _searcher(k: int):
    def work(columns: dict[str, pa.Array]) -> pa.RecordBatch | None:
        ids = columns["ids"]
        c = np.flatnonzero(np.asarray(ids.is_valid()))
        q = np.flatnonzero(~np.asarray(ids.is_valid()))
        if not len(c) or not len(q):
            return None
        v = columns["v"]
        x, own = matrix(v.take(pa.array(c))), columns["query_id"].to_pylist()
        holders = [ids[i].as_py() for i in c.tolist()]
        out: list[tuple[int, list[dict]]] = []
        for at in range(0, len(q), 512):
            some = q[at : at + 512]
            pick, score = top_products(matrix(v.take(pa.array(some))), x, k + 1)
            for row, picked, scores in zip(some.tolist(), pick.tolist(), score.tolist()):
                found = sorted((-s, i) for s, p in zip(scores, picked) for i in holders[p] if i != own[row])[:k]
                out.append((own[row], [{"neg": s, "vec_id": i} for s, i in found]))
        kind = pa.list_(pa.struct([("neg", pa.float64()), ("vec_id", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out], kind)], ["query_id", "found"])

    return work


def _search(vectors: DataFrame, queries: DataFrame, k: int, recall: float) -> DataFrame:
    tree, _ = _grown(vectors)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf_of(matrix(batch.column(1))) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], ["node", "v", "ids", "leaf"])

    index = stored(vectors.select("node", "v", "ids").mapInArrow(tidy(place), "node long, v array<double>, ids array<long>, leaf int"))
    visits = _calibrated(index, queries, tree, k, recall)
    held = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n")).collect():
        held[r["leaf"]] = r["n"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = tree.visited(matrix(batch.column(1)), visits, held, k + 1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], ["query_id", "v", "leaves"])

    routed = queries.select("query_id", "v").mapInArrow(tidy(route), "query_id long, v array<double>, leaves array<int>")
    routed = stored(routed.withColumn("leaf", F.explode("leaves")).drop("leaves"))
    many = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("cparts"))
    asked = routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("qparts"))
    parts = many.join(asked, "leaf")
    upto = {"cp": F.sequence(F.lit(0), F.col("cparts") - 1), "qp": F.sequence(F.lit(0), F.col("qparts") - 1)}
    rows = lookup_join(index, parts, ["leaf"]).select(
        "leaf", F.pmod(F.xxhash64("node"), F.col("cparts")).cast("int").alias("cp"), F.explode(upto["qp"]).alias("qp"),
        F.lit(None).cast("long").alias("query_id"), "v", "ids",
    )
    asks = lookup_join(routed, parts, ["leaf"]).select(
        "leaf", F.explode(upto["cp"]).alias("cp"), F.pmod(F.xxhash64("query_id"), F.col("qparts")).cast("int").alias("qp"),
        "query_id", "v", F.lit(None).cast("array<long>").alias("ids"),
    )
    found = per_cell(rows.unionByName(asks), ["leaf", "cp", "qp"], _searcher(k), "query_id long, found array<struct<neg:double,vec_id:long>>")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("nth", "hit")).select(
        "query_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score")
    )


def nearest_vectors(vectors: DataFrame, asked: DataFrame, k: int = 20, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each row of ``asked`` found among ``vectors``.

    Both have vec_id and embedding. A tree is trained on a bounded sample; every vector goes to its leaf; a query
    visits leaves in best-bin-first order, as many as a bounded set of calibration queries, compared with all
    vectors by brute force, needs for the recall, and on until they hold more than ``k`` ids. Products are exact, in double precision; ties go to the smaller id.

    Equal vectors are one entry with its ``k + 1`` smallest ids, which is all that ties can ask for. The query's own
    id is no candidate; rows that share an id and a vector count once, and a query id with several vectors
    asks with the smallest. Vectors that are NULL, empty, zero or hold NULL or non-finite components take no
    part, nor do NULL ids; vectors of another length than the query's are no candidates. Empty tables give no rows.
    """
    def usable(df: DataFrame) -> DataFrame:
        some = df.where(sound(F.col("embedding")) & F.col("vec_id").isNotNull())
        return some.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))

    named = usable(vectors).withColumn("node", F.xxhash64("v")).distinct()
    first = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    few = named.withColumn("_nth", first).where(F.col("_nth") <= k + 1)
    classes = stored(few.groupBy("node").agg(F.first("v").alias("v"), F.collect_list("vec_id").alias("ids")))
    queries = stored(usable(asked).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")))
    lengths = [r["dim"] for r in queries.select(F.size("v").alias("dim")).distinct().collect()] or [0]
    found = [_search(classes.where(F.size("v") == dim), queries.where(F.size("v") == dim), k, recall) for dim in lengths]
    return reduce(DataFrame.unionByName, found)


@query("op9_kmeans_tree_search")
def op9_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_vectors(vectors, vectors.where(F.col("vec_id") % 20 == 0))
