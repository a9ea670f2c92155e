"""Embedding near-dedup with a robust-pruned flat graph built on overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrisk.llm.common import connected, tidy
from seqrisk.llm.registry import query, table
from seqrisk.llm.simhash import _fold
from seqrisk.llm.vectors import kmeans, matrix, per_cell, sound
from seqrisk.plans.joins import lookup_join, stored

COSINE = 0.93
#: Vectors of a cluster shard aimed at, all shards together, and values of the sample that trains their centres.
SHARD, MOST_SHARDS, SAMPLE_VALUES = 2000, 2048, 4_000_000
#: A vector belongs to all shards whose centre is at most this much less similar than its own's. A pair is
#: lost only if neither end comes to the other's shard.
MARGIN = 0.07
#: Vectors of one cell; larger shards are dealt out as pairs of parts.
PART = 4096
#: Candidates of the pruning, kept neighbours, pruning factor, and medoids from which a search starts.
POOL, DEGREE, ALPHA, MEDOIDS = 32, 24, 1.2, 32
#: Expansions of a search, besides those within the radius.
BEAM = 16
#: Doublings of a cell's beam at most.
WIDENINGS = 3
#: Queries audited in each cell and over all vectors, and the recall aimed at.
CELL_AUDIT, AUDIT, RECALL = 64, 1024, 0.99


def medoids(x: np.ndarray) -> np.ndarray:
    """Rows nearest to the centres of a few clusters."""
    centres = kmeans(x, min(MEDOIDS, len(x)), rounds=4)
    return np.unique((x @ centres.T).argmax(axis=0))


def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Neighbour lists of unit vectors after robust pruning, with the nearest reverse edges.

    Each row takes its nearest candidate and drops those that are nearer to it (by ALPHA) than to the row,
    again and again. Medoids and a few fixed others are candidates of all rows, which keeps tight groups
    reachable from afar.
    """
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)]
    x = x.astype(np.float32)
    pool = min(POOL, n - 1)
    far = np.concatenate([medoids(x)[: POOL // 2], np.random.default_rng(1).integers(0, n, 8)])
    lists: list[np.ndarray] = []
    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        here = np.arange(len(rows))
        sims = x[rows] @ x.T
        sims[here, rows] = -2
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        cand = np.concatenate([near, np.broadcast_to(far, (len(rows), len(far)))], axis=1)
        dist = 1 - np.take_along_axis(sims, cand, axis=1)
        dist[cand == rows[:, None]] = np.inf
        order = np.argsort(dist, axis=1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, axis=1), np.take_along_axis(dist, order, axis=1)
        own = x[cand]
        between = 1 - own @ own.transpose(0, 2, 1)
        alive, kept = np.isfinite(dist), np.zeros(dist.shape, bool)
        for _ in range(DEGREE):
            first = alive.argmax(axis=1)
            some = alive[here, first]
            if not some.any():
                break
            kept[here[some], first[some]] = True
            alive &= ALPHA * between[here, first] > dist
            alive[here, first] = False
        lists += [cand[i, kept[i]] for i in range(len(rows))]
    source = np.repeat(np.arange(n), [len(a) for a in lists])
    target = np.concatenate(lists)
    close = np.einsum("rd,rd->r", x[source], x[target])
    order = np.lexsort((-close, target))
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    back = [[] for _ in range(n)]
    for s, t in zip(source[rank < DEGREE].tolist(), target[rank < DEGREE].tolist()):
        back[t].append(s)
    return [np.union1d(a, np.array(b, np.int64)) for a, b in zip(lists, back)]


def range_search(q: np.ndarray, x: np.ndarray, lists: list[np.ndarray], start: np.ndarray, radius: float, beam: int) -> np.ndarray:
    """Pairs (query, row) with similarity of at least ``radius`` that a greedy search reaches.

    All queries advance together. A query expands its most similar known row; after ``beam`` expansions it
    goes on only while that row is within the radius, so that the search widens over the whole range.
    """
    degree = np.array([len(a) for a in lists])
    flat, first = np.concatenate([*lists, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum(degree)[:-1]])
    known = np.full((len(q), len(x)), -2.0, np.float32)
    known[:, start] = (q @ x[start].T).astype(np.float32)
    front = known.copy()  # known and not expanded
    active, step = np.arange(len(q)), 0
    low = np.float32(radius) - np.float32(1e-5)
    while len(active):
        best = front[active].argmax(axis=1)
        value = front[active, best]
        go = value > -2 if step < beam else value >= low
        active, best = active[go], best[go]
        front[active, best] = -2
        many = degree[best]
        owner = np.repeat(active, many)
        row = flat[np.repeat(first[best] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())] if len(best) else best
        new = known[owner, row] == -2
        owner, row = owner[new], row[new]
        sims = np.einsum("rd,rd->r", q[owner], x[row]).astype(np.float32)
        known[owner, row] = sims
        front[owner, row] = sims
        step += 1
    one, two = np.nonzero(known >= low)
    exact = np.einsum("rd,rd->r", q[one], x[two])
    return np.stack([one[exact >= radius], two[exact >= radius]], axis=1)


def _build(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    x = matrix(columns["unit"])
    node = columns["node"].to_numpy()
    lists = [node[a] for a in pruned_graph(x)]
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(lists, pa.list_(pa.int64()))], ["node", "near"])


def _searcher(cosine: float, beam: int):
    def work(columns: dict[str, pa.Array]) -> pa.RecordBatch | None:
        unit, node = matrix(columns["unit"]), columns["node"].to_numpy()
        here = columns["shard"][0].as_py()
        c = np.flatnonzero(columns["is_candidate"].to_numpy(zero_copy_only=False))
        q = np.flatnonzero(columns["is_query"].to_numpy(zero_copy_only=False))
        if not len(c) or not len(q):
            return None
        size, owner = columns["size"].to_numpy(), columns["owner"].to_numpy()
        x, order = unit[c], np.argsort(node[c])
        ids = node[c][order]
        lists = []
        for a in columns["near"].take(pa.array(c)):
            a = a.values.to_numpy() if a.is_valid else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(ids, a), len(ids) - 1)
            lists.append(order[at[ids[at] == a]])
        start = medoids(x)
        label = np.arange(len(node))
        sample = q[np.unique(np.linspace(0, len(q) - 1, CELL_AUDIT).astype(int))]
        a, b = np.nonzero(unit[sample] @ x.T >= cosine)
        for wide in range(WIDENINGS + 1):  # until the audited queries are put together with all they link to
            found = range_search(unit[q], x, lists, start, cosine, beam << wide)
            _fold(label, q[found[:, 0]], c[found[:, 1]])
            if (label[sample[a]] == label[c[b]]).sum() >= RECALL * len(a):
                break
        else:  # the search does not do here: all pairs of the cell, which is bounded
            for at in range(0, len(q), 512):
                one, two = np.nonzero(unit[q[at : at + 512]] @ x.T >= cosine)
                _fold(label, q[at + one], c[two])
        # Verification: all pairs of what the search has put together, query against owned candidate.
        links = np.zeros(len(node), np.int64)
        is_q, owned = np.zeros(len(node), bool), np.zeros(len(node), bool)
        is_q[q], owned[c] = True, owner[c] == here
        seen = np.zeros((len(node), max(int(owner.max()), max(map(max, columns["visits"].to_pylist()))) + 1), bool)
        for b, shards in enumerate(columns["visits"].to_pylist()):
            seen[b, shards] = True
        order = np.argsort(label, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            if len(group) > 1:
                a, b = group[is_q[group]], group[owned[group]]
                near = (unit[a] @ unit[b].T >= cosine) & (a[:, None] != b)
                links[a] += near @ size[b]
                # The other end, where it does not come to this one's shard to count it itself.
                links[b] += (near & ~seen[b][:, owner[a]].T).T @ size[a]
        on = np.flatnonzero((links > 0) | (label != np.arange(len(node))))
        return pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(links[on]), pa.array(node[label[on]])], ["node", "links", "root"])

    return work


def _centres(classes: DataFrame) -> dict[str, np.ndarray]:
    """Centres of the shards of each group, trained on a bounded sample."""
    groups = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("unit")).alias("dim"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    scale = max(float(SHARD), 1.5 * total / MOST_SHARDS)
    large = {r["grp"]: (r["n"], r["dim"]) for r in groups.where(F.col("n") > scale * 1.5).collect()}
    if not large:
        return {}
    rows = sum(min(n, 64 * -(-n // int(scale))) for n, _ in large.values())
    rows = min(rows, SAMPLE_VALUES // max(d for _, d in large.values()))
    part = rows / sum(n for n, _ in large.values())
    picked = classes.where(F.col("grp").isin(list(large)) & (F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < part * (1 << 20)))
    sample: dict[str, list] = {}
    for r in picked.select("node", "grp", "unit").orderBy("node").toLocalIterator():
        sample.setdefault(r["grp"], []).append(r["unit"])
    out = {}
    for grp, x in sample.items():
        centres = kmeans(np.array(x), -(-large[grp][0] // int(scale)))
        norm = np.linalg.norm(centres, axis=1, keepdims=True)
        out[grp] = centres / np.where(norm > 0, norm, 1)
    return out


def _sharded(classes: DataFrame, centres: dict[str, np.ndarray], margin: float) -> DataFrame:
    """``classes`` with ``owner`` (nearest shard) and ``visits`` (all shards within the margin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, visits = [], []
            for grp, unit in zip(batch.column(1).to_pylist(), batch.column(2)):
                c = centres.get(grp)
                if c is None:
                    owner.append(0)
                    visits.append([0])
                    continue
                near = c @ unit.values.to_numpy()
                owner.append(int(near.argmax()))
                visits.append(np.flatnonzero(near >= near.max() - margin).tolist())
            cols = [*batch.columns, pa.array(owner, pa.int32()), pa.array(visits, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "owner", "visits"])

    return classes.select("node", "grp", "unit", "size").mapInArrow(
        tidy(run), "node long, grp string, unit array<double>, size long, owner int, visits array<int>"
    )


def _links(classes: DataFrame, cosine: float, margin: float, beam: int) -> DataFrame:
    """``node, links, root`` rows: partial link counts and edges, from one build and search."""
    sharded = stored(_sharded(classes, _centres(classes), margin))
    members = sharded.withColumn("shard", F.explode("visits"))
    sizes = members.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("grp", "shard", F.ceil(F.col("_n") / PART).cast("int").alias("parts"))
    members = lookup_join(members, sizes, ["grp", "shard"])
    members = members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    lists = per_cell(members.select("grp", "shard", "part", "node", "unit"), ["grp", "shard", "part"], _build, "node long, near array<long>")
    union = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    joined = members.join(stored(union), "node")
    all_parts = F.sequence(F.lit(0), F.col("parts") - 1)
    as_candidate = F.transform(all_parts, lambda p: F.struct(F.col("part").alias("cp"), p.alias("qp")))
    as_query = F.transform(all_parts, lambda p: F.struct(p.alias("cp"), F.col("part").alias("qp")))
    cells = joined.withColumn("cell", F.explode(F.array_union(as_candidate, as_query))).select(
        "grp", "shard", "cell.cp", "cell.qp", "node", "unit", "size", "owner", "visits", "near",
        (F.col("part") == F.col("cell.cp")).alias("is_candidate"), (F.col("part") == F.col("cell.qp")).alias("is_query"),
    )
    return stored(per_cell(cells, ["grp", "shard", "cp", "qp"], _searcher(cosine, beam), "node long, links long, root long"))


def _audit(classes: DataFrame, links: DataFrame, cosine: float) -> float:
    """Share of the true links of a bounded sample of vectors that were found, by brute force in blocks.

    Half of the sample is any vectors, half such that have links: where links are rare, the first half alone would have none
    to measure by.
    """
    linked = links.where(F.col("links") > 0).select("node").distinct()
    own = classes.join(linked.orderBy(F.xxhash64("node", F.lit(5))).limit(AUDIT // 2).hint("broadcast"), "node", "left_semi")
    some = classes.orderBy(F.xxhash64("node", F.lit(5))).limit(AUDIT // 2)
    picked = some.select("node", "grp", "unit").unionByName(own.select("node", "grp", "unit")).dropDuplicates(["node"]).collect()
    by_grp: dict[str, tuple[list, np.ndarray]] = {}
    for r in picked:
        by_grp.setdefault(r["grp"], ([], []))[0].append(r["node"])
        by_grp[r["grp"]][1].append(r["unit"])
    by_grp = {g: (nodes, np.array(units)) for g, (nodes, units) in by_grp.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grps = np.array(batch.column(1).to_pylist(), object)
            for grp, (nodes, units) in by_grp.items():
                on = np.flatnonzero(grps == grp)
                if len(on):
                    x, size, node = matrix(batch.column(2).take(pa.array(on))), batch.column(3).to_numpy()[on], batch.column(0).to_numpy()[on]
                    near = (units @ x.T >= cosine) & (np.array(nodes)[:, None] != node)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(near @ size)], ["node", "true"])

    true = classes.select("node", "grp", "unit", "size").mapInArrow(tidy(run), "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    found = links.groupBy("node").agg(F.sum("links").alias("found"))
    got = true.join(found, "node", "left").agg(F.sum("true").alias("t"), F.sum(F.least("true", F.coalesce("found", F.lit(0)))).alias("f")).first()
    return got["f"] / got["t"] if got["t"] else 1.0


def vector_components(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (vec_id, embedding, label).

    Equal vectors of a label are one class with a size, so copies are neither compared nor expanded. Classes
    are dealt to the shards of all centres nearly as near as the nearest; each shard builds a robust-pruned
    graph, a class's lists of all shards are united, and each shard is searched from its medoids for all its
    members. What the searches put together is verified pair by pair in double precision. A link counts in the
    shard that owns the other end, so pairs are counted where they are found and not sent. Recall is audited by brute force, in each
    cell (which is compared pair by pair if a wider beam does not help) and over all vectors; below the aim the search is run
    again with a wider overlap and beam, and a recall that stays below it is an error.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components, and those with a NULL label,
    link with nothing; neither do vectors of different length. Rows that repeat are rows; a NULL vec_id names no
    component; an empty table gives no rows; other columns are ignored.
    """
    vector = F.col("embedding").cast("array<double>")
    fit = F.col("label").isNotNull() & sound(F.col("embedding"))
    rows = vectors.select("vec_id", F.when(fit, F.col("label").cast("string")).alias("_label"), F.when(fit, vector).alias("_v"))
    named = stored(rows.withColumn("node", F.when(F.col("_v").isNotNull(), F.xxhash64("_label", "_v"))))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    biggest = F.aggregate("_v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    classes = (
        named.where(F.col("node").isNotNull()).groupBy("node")
        .agg(F.first("_label").alias("_label"), F.first("_v").alias("_v"), F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least"))
        .withColumn("_big", biggest).withColumn("_v", F.transform("_v", lambda x: x / F.col("_big"))).withColumn("_norm", norm)
        .select("node", F.concat_ws("|", F.size("_v").cast("string"), "_label").alias("grp"), F.transform("_v", lambda x: x / F.col("_norm")).alias("unit"), "size", "least")
    )
    classes = stored(classes)
    margin, beam = MARGIN, BEAM
    while True:
        links = _links(classes, cosine, margin, beam)
        got = _audit(classes, links, cosine)
        if got >= recall:
            break
        if margin > 2:  # every vector has been to every shard
            raise ValueError(f"only {got:.4f} of the audited links were found, {recall} are asked for")
        margin, beam = margin * 2, beam * 2
    roots = connected(links.select("node", "root"), "node", "root").withColumnRenamed("node", "_node")
    counts = links.groupBy(F.col("node").alias("_linked")).agg(F.sum("links").alias("links"))
    placed = stored(
        classes.join(counts, F.col("node") == F.col("_linked"), "left").join(roots, F.col("node") == F.col("_node"), "left")
        .select("node", "least", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    )
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(names, "root").select("node", "component_id", (F.col("links") + F.col("size") - 1).alias("n_links"))
    out = lookup_join(named.select("vec_id", "node"), placed, ["node"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


@query("op2_flat_graph_dedup")
def op2_flat_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(table(spark, sf_dir, "embeddings"))
