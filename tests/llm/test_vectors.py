import numpy as np
import pytest

from seqrisk.llm import vector_dedup as D
from seqrisk.llm import vector_search as S

ODD = [
    (9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [float("nan")] * 16, 1), (9005, [float("inf")] + [1.0] * 15, 1),
    (9006, [None] + [1.0] * 15, 1), (9007, [1.0] * 16, None), (9008, [1.0] * 5, 1), (9009, [2.0] * 5, 1),
]
SCHEMA = "vec_id long, embedding array<float>, label int, unit array<double>, owner string, node string"


def vectors(n: int = 500) -> list[tuple]:
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    for i in range(n // 2, n, 3):  # near copies
        x[i] = x[i % 40] + 0.05 * rng.normal(size=16)
    x[100:130] = x[99] * np.linspace(1, 3, 30, dtype=np.float32)[:, None]  # same direction
    x[200:230] = x[199]  # copies
    return [(i * 3, v.tolist(), i % 3 if i < 90 else i % 2) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [r + (None, "x", "y") for r in vectors() + ODD]
    return spark.createDataFrame(rows + rows[:2], SCHEMA).repartition(3)


def test_links_equal_brute_force(table):
    rows = vectors()
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, label = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    links = near.sum(axis=1) + near[:, :2].sum(axis=1)  # the first two rows are there twice
    links[:2] += 1
    least = ids.copy()
    for _ in range(len(ids)):
        low = np.where(near, least[None, :], least[:, None]).min(axis=1)
        low = np.minimum(low, least)
        if (low == least).all():
            break
        least = low
    got = {r["vec_id"]: r for r in D.vector_components(table).collect()}
    assert all(got[i]["n_links"] == n and got[i]["component_id"] == k and got[i]["kept"] == (i == k) for i, n, k in zip(ids.tolist(), links.tolist(), least.tolist()))
    assert all(got[r[0]]["n_links"] == 0 and got[r[0]]["component_id"] == r[0] for r in ODD[:7])
    assert got[9009]["component_id"] == 9008


def test_shards_and_parts(table, monkeypatch):
    whole = sorted(map(repr, D.vector_components(table).collect()))
    for name, value in (("SHARD", 40), ("PART", 32)):
        monkeypatch.setattr(D, name, value)
    cut = sorted(map(repr, D.vector_components(table).collect()))
    assert np.mean([a == b for a, b in zip(whole, cut)]) >= 0.99


def test_search_reaches_the_range():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[150:] = x[0] + 0.1 * rng.normal(size=(150, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = D.range_search(x, x, D.pruned_graph(x), D.medoids(x), 0.93, 24)
    assert len(got) >= 0.97 * (x @ x.T >= 0.93).sum()


def brute(rows, query, k):
    own = dict((r[0], np.array(r[1], np.float64)) for r in rows)
    scored = sorted((-float((own[query] * v).sum()), i) for i, v in own.items() if i != query)
    return [(i, -s) for s, i in scored[:k]]


def test_neighbours_equal_brute_force_in_one_leaf(table):
    rows = vectors()
    got = {}
    for r in S.nearest_vectors(table, table.where("vec_id % 60 = 0"), k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {r[0] for r in rows if r[0] % 60 == 0}
    for q, found in got.items():
        found.sort()
        want = brute(rows, q, 10)
        assert [n for n, _, _ in found] == list(range(1, 11)) and [v for _, v, _ in found] == [v for v, _ in want]
        assert np.allclose([s for _, _, s in found], [s for _, s in want], rtol=0, atol=1e-12)


def test_recall_over_many_leaves_and_parts(table, monkeypatch):
    monkeypatch.setattr(S, "LEAF", 40)
    monkeypatch.setattr(S, "PART", 16)
    rows = vectors()
    hits = total = 0
    got = {}
    for r in S.nearest_vectors(table, table.where("vec_id % 30 = 0"), k=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in got:
        hits, total = hits + len({v for v, _ in brute(rows, q, 10)} & got[q]), total + 10
    assert hits / total >= 0.9


def test_empty_tables(table):
    none = table.where("1 = 0")
    assert D.vector_components(none).count() == 0
    assert S.nearest_vectors(none, none).count() == 0 and S.nearest_vectors(table, none).count() == 0
    alone = table.where("vec_id = 3").limit(1)
    assert S.nearest_vectors(alone, alone).count() == 0


def test_queries_in_small_leaves_get_all_their_neighbours(spark, monkeypatch):
    """Leaves of a few vectors and a recall that one leaf would do for: still k rows for every query."""
    monkeypatch.setattr(S, "LEAF", 4)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 6))
    df = spark.createDataFrame([(n, v.tolist(), 0) for n, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = S.nearest_vectors(df, df.where("vec_id % 10 = 0"), k=12, recall=0.05)
    assert {r["count"] for r in found.groupBy("query_id").count().collect()} == {12} and found.select("query_id").distinct().count() == 24
    tree = S.Tree.grown(x, 4)
    held = np.bincount(tree.leaf_of(x), minlength=tree.leaves)
    for leaves in tree.visited(x[:20], 1, held, 13):
        assert held[leaves].sum() >= 13 and held[leaves[:-1]].sum() < 13


def test_audit_measures_where_links_are_rare(spark):
    """Three linked vectors among 3000: a sample of any vectors has none of them; one of their links is missing."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x[1], x[2] = x[0] + 0.01 * rng.normal(size=(2, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    classes = spark.createDataFrame([(n, "g", v.tolist(), 1) for n, v in enumerate(x)], "node long, grp string, unit array<double>, size long")

    def links(*counts):
        return spark.createDataFrame([(n, c, 0) for n, c in enumerate(counts) if c], "node long, links long, root long")

    assert D._audit(classes, links(2, 2, 2), 0.93) == 1.0
    assert D._audit(classes, links(1, 2, 1), 0.93) == pytest.approx(4 / 6)


def test_recall_that_stays_low_is_an_error(table, monkeypatch):
    monkeypatch.setattr(D, "_audit", lambda *_: 0.5)
    with pytest.raises(ValueError, match="only 0.5000 of the audited links"):
        D.vector_components(table)
