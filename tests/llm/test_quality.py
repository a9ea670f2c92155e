import zlib

import numpy as np

from seqrisk.llm.quality import N_FEATURES, bradley_terry, good_documents, quality_scores

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    good = [r["predicted"] for r in held if r["quality"] == 1]
    bad = [r["predicted"] for r in held if r["quality"] == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality_scores(docs, labels).where("predicted = 1").count()


def test_edge_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(20, 1), (21, 0), (22, 1), (22, 0), (23, None), (None, 1), (24, 1), (25, 0), (70, 1)], "doc_id long, quality int")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert quality_scores(no_docs, labels).count() == 0
    assert {r["score"] for r in quality_scores(docs, labels.where("quality = 1")).collect()} == {0.5}


def test_labels_of_held_out_rows_change_nothing(spark, docs):
    learn = [n for n in range(1, 80) if zlib.crc32(str(n).encode()) % 3 != 1]
    hold = [n for n in range(1, 80) if zlib.crc32(str(n).encode()) % 3 == 1]
    one = spark.createDataFrame([(n, n % 2) for n in learn] + [(n, 1) for n in hold], "doc_id long, quality int")
    two = spark.createDataFrame([(n, n % 2) for n in learn] + [(n, 0) for n in hold], "doc_id long, quality int")
    assert sorted(map(repr, quality_scores(docs, one).collect())) == sorted(map(repr, quality_scores(docs, two).collect()))


def test_pairwise_scores_order_the_classes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, N_FEATURES))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.3).astype(int)
    model = bradley_terry(x, y)
    assert ((x @ np.array(model.weights) + model.shift > 0) == y).mean() > 0.97
