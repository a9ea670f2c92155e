import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from seqrisk.llm.simhash import near_copies, wide_fingerprint

SF = "/root/testdata/sf0.001"


def survivors(texts):
    """The smallest id of each component under Jaccard 0.8 of five-word shingles, all pairs tried; all without words."""
    sets = {}
    for doc, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else None
    root = {doc: doc for doc in texts}

    def find(doc):
        while root[doc] != doc:
            doc = root[doc]
        return doc

    ids = sorted(d for d in texts if sets[d])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {doc for doc in texts if find(doc) == doc}


def test_each_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(path := f"{tmp_path}/{n}")
        docs = spark.read.parquet(path)
        assert n == 4 or docs.columns == columns
        seen.append(docs.collect())
    raw, good, single, cut, mixed, packed = seen
    assert {r["doc_id"] for r in good} < {r["doc_id"] for r in raw} and len(good) > 0.7 * len(raw)

    assert {r["doc_id"] for r in single} == survivors({r["doc_id"]: r["text"] for r in good})

    lines = [ln for r in cut for ln in {" ".join(x.lower().split()) for x in (r["text"] or "").split("\n") if len(x.split()) >= 20}]
    assert len(lines) == len(set(lines)) and len(cut) <= len(single)

    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)
    assert abs(words(mixed) / words(cut) - 1.5) < 0.1 and {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in cut}

    pieces = sorted(r["doc_id"] for r in packed if r["piece"] == 0)
    assert pieces == sorted(r["doc_id"] for r in mixed)
    filled = {}
    for r in packed:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert max(filled.values()) <= 1024 and len(filled) <= 1.06 * sum(filled.values()) / 1024 + 1


def test_run_returns_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns[:4] == ["doc_id", "piece", "start", "length"]


@pytest.mark.parametrize("empty", [False, True])
def test_all_stages_on_edge_rows(spark, docs, no_docs, tmp_path, empty):
    (no_docs if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    labels = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).distinct()
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (not rows) if empty else rows
    left = no_docs if empty else docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return words


def test_edited_copies_are_found(spark):
    """Edited copies between 0.8 and 1, in groups of two, against all pairs; unlike texts stay."""
    rng = random.Random(8)
    texts = {}
    for n in range(150):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([40, 120, 400]))]
        texts[2 * n] = " ".join(words)
        texts[2 * n + 1] = " ".join(edited(rng, words, rng.randint(0, max(1, len(words) // 40))))
    want = survivors(texts)
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(4)
    found = {r["doc_id"] for r in near_copies(df).where("doc_id = component_id").collect()}
    assert want <= found and len(texts) - len(found) >= 0.95 * (len(texts) - len(want))
    assert len(want) < 220


def test_fingerprints_tell_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 800, dtype=np.uint64)
    b = np.concatenate([a[:711], rng.integers(0, 1 << 62, 89, dtype=np.uint64)])  # Jaccard 0.8
    x, y = wide_fingerprint(a, 64), wide_fingerprint(b, 64)
    apart = int(np.bitwise_count(x ^ y).sum()) / (64 * 64)
    assert abs(apart - np.arccos(711 / 800) / np.pi) < 0.02
    other = wide_fingerprint(rng.integers(0, 1 << 62, 800, dtype=np.uint64), 64)
    assert abs(int(np.bitwise_count(x ^ other).sum()) / (64 * 64) - 0.5) < 0.05
