import zlib
from collections import Counter

import numpy as np

from seqrisk.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards


def test_exact_sizes_and_gapless_slots(docs, no_docs):
    rows = shuffle_into_shards(docs, shards=7).collect()
    assert len(rows) == docs.count()
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.get(j, 0) for j in range(7)) <= 1
    for j, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == j) == list(range(n))
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.select("doc_id", "text").collect()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in rows if r["doc_id"])
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    assert shuffle_into_shards(no_docs).count() == 0


def test_more_shards_than_rows(spark):
    rows = shuffle_into_shards(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), shards=5).collect()
    assert sorted(r["slot"] for r in rows) == [0, 0] and len({r["shard"] for r in rows}) == 2


def test_matrix_has_the_margins():
    matrix = np.array(communication_matrix([5, 0, 100, 17], 4, seed=1))
    assert matrix.sum(axis=1).tolist() == [5, 0, 100, 17] and sorted(matrix.sum(axis=0).tolist()) == [30, 30, 31, 31]


def test_rows_go_anywhere_evenly(spark):
    docs = spark.range(0, 600, 1, 3).selectExpr("id doc_id", "'x' text")
    hits = Counter()
    for seed in range(4):
        hits.update((r["doc_id"] // 200, r["shard"]) for r in shuffle_into_shards(docs, shards=3, seed=seed).collect())
    assert all(abs(n - 800 / 3) < 80 for n in hits.values()) and len(hits) == 9


def test_large_hypergeometric_numbers():
    rng = np.random.default_rng(2)
    good, bad, draws = 3 * 10**9, 7 * 10**9, 10**9
    got = np.array([hypergeometric(rng, good, bad, draws) for _ in range(2000)], float)
    spread = np.sqrt(draws * 0.3 * 0.7 * 0.9)
    assert abs(got.mean() - draws * 0.3) < 5 * spread / np.sqrt(2000) and 0.93 < got.std() / spread < 1.07
