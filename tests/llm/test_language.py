import numpy as np

from seqrisk.llm.language import Letters, fit_language, language_spans, languages, viterbi
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def brute_viterbi(score, penalty):
    n, k = score.shape
    best, back = score[0].copy(), []
    for t in range(1, n):
        top = int(best.argmax())
        from_ = [j if best[j] >= best[top] - penalty else top for j in range(k)]
        best = np.array([max(best[j], best[top] - penalty) for j in range(k)]) + score[t]
        back.append(from_)
    state = [int(best.argmax())]
    for from_ in reversed(back):
        state.append(from_[state[-1]])
    return state[::-1]


def test_viterbi_equals_a_plain_one():
    rng = np.random.default_rng(3)
    owner = np.repeat(np.arange(9), [1, 7, 3, 30, 2, 2, 11, 1, 5])
    score = rng.integers(-6, 0, (len(owner), 3)).astype(np.float32)
    got = viterbi(owner, score, 4.0)
    for doc in range(9):
        assert got[owner == doc].tolist() == brute_viterbi(score[owner == doc].astype(float), 4.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.98


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_language(docs)
    en, de = (docs.where(f"lang = '{k}' and n_chars between 400 and 900").orderBy("doc_id").first()["text"] for k in ("en", "de"))
    mixed = spark.createDataFrame([(en + "\n" + de + "\n" + en,)], "text string")
    spans = mixed.select(language_spans(model, F.col("text")).alias("s")).first()["s"]
    assert [s["lang"] for s in spans] == ["en", "de", "en"]
    assert abs(spans[1]["begin"] - len(en)) < 25 and abs(spans[1]["end"] - len(en) - len(de)) < 25


def test_edge_cases(spark, docs, no_docs):
    rows = {r["doc_id"]: r for r in languages(docs).where("doc_id != 20").collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[7]["lang_pred"] != "und"
    assert languages(no_docs).count() == 0
    assert {r["lang_pred"] for r in languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_scripts_narrow_the_candidates(spark):
    rows = [(n, "привет мир как дела", "ru") for n in range(20)] + [(100 + n, "hello world how are you", "en") for n in range(20)]
    rows += [(200, "мир", None), (201, "hello мир привет дела hello how are you world", None)]
    got = {r["doc_id"]: r for r in languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[200]["lang_pred"] == "ru" and got[201]["lang_pred"] == "en" and 0.4 < got[201]["score"] < 1


def test_words_of_letters():
    tables = Letters()
    _, _, owner, first, begin, end = tables.words(["Ab, c1d", "", "é"])
    assert owner.tolist() == [0, 0, 0, 2] and begin.tolist() == [0, 4, 6, 0] and end.tolist() == [2, 5, 7, 1] and first.tolist() == [0, 2, 3, 4]
