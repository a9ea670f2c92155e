"""Joins, subgroups, codes, vocabulary, filters, readers and writers."""

import pytest
from pyspark.sql import functions as F

from seqrisk import schemas
from seqrisk.operators import codes as C
from seqrisk.operators import features as W
from seqrisk.operators import filters as X
from seqrisk.operators import joins as J
from seqrisk.operators import subgroup as U
from seqrisk.operators import summary as A
from seqrisk.operators import vocab as T
from seqrisk.plans.joins import lookup_join, stored
from seqrisk.sources import readers as R
from seqrisk.sources import writers as Q


def test_required_and_default_columns(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [3.0, 1.0])], "row_id long, codes array<string>, days_before_prediction array<double>")
    with pytest.raises(ValueError, match="label.*split.*subject_id"):
        schemas.require_columns(df, schemas.REQUIRED_EXAMPLE)
    row = schemas.default_example_columns(df, "t").first()
    assert (row["task"], row["delta_days"], row["numeric_values"]) == ("t", [0.0, 2.0], [None, None])
    cost = schemas.default_cost_columns(spark.createDataFrame([(5, 2)], "seq_len int, n_compression_events int")).first()
    assert (cost["raw_seq_len"], cost["n_events_removed_vs_raw"], cost["n_synthetic_events"]) == (5, 0, 2)


def test_validated_left_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, x string")
    right = spark.createDataFrame([(1, "r")], "k int, y string")
    assert sorted(map(tuple, J.validated_left_join(left, right, ["k"]).collect())) == [(1, "a", "r"), (1, "b", "r"), (2, "c", None)]
    with pytest.raises(Exception, match="left join keys are not unique"):
        J.validated_left_join(left, right, ["k"], one_to_one=True).collect()
    with pytest.raises(Exception, match="right join keys are not unique"):
        J.validated_left_join(left, right.union(right), ["k"]).collect()


def test_align_rejects_other_labels(spark):
    cols = "task string, model string, seed int, calibration string, version string, row_id long, subject_id long, y_true int, risk double"
    rows = [("t", "m", 1, "raw", v, 1, 1, y, 0.5) for v, y in (("raw", 1), ("x", 0))]
    with pytest.raises(Exception, match="Mismatched labels"):
        J.align_to_baseline(spark.createDataFrame(rows, cols), "raw").collect()


def test_dedup_of_many_copies(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("o"), (F.col("id") * 2).alias("v"))
    got = {r["k"]: r["v"] for r in J.dedup(df, ["k"], ["o"]).collect()}
    assert got == {1: 2997 * 2, 0: 2999 * 2}
    assert {r["k"]: r["v"] for r in J.dedup(df, ["k"], ["o"], "first").collect()} == {1: 0, 0: 2}


def test_empty_joins_raise(spark):
    a = spark.createDataFrame([("t", 1, 1, 1, 0.5)], "task string, row_id long, subject_id long, y_true int, risk double")
    with pytest.raises(ValueError, match="0 rows"):
        J.paired_join(a, a.withColumn("row_id", F.lit(2).cast("long")), check=True)
    with pytest.raises(ValueError):
        X.task_filter(a, ["none"], check=True)


def test_lookup_join_beyond_its_limit(spark):
    big = spark.range(100).select((F.col("id") % 10).alias("k"), "id")
    table = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small, large = lookup_join(big, table, ["k"], "left"), lookup_join(big, table, ["k"], "left", max_rows=3)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    assert "SortMergeJoin" in large._jdf.queryExecution().toString()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_stored_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, ["a"], None), (2, None, 0.5)], "a int, b array<string>, c double")
    back = stored(df)
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())


def test_zero_threshold_takes_everyone(spark):
    rows = [("t", i, i, "held_out", 0, 0.0, 1.0, 0.0) for i in range(5)]
    audit = spark.createDataFrame(rows, "task string, row_id long, subject_id long, split string, label int, repeat_removed_first_last double, raw_sequence_length_non_static double, n_diag_codes_persistent_365d double")
    cut = U.high_repeat_threshold(audit, ["t"])
    assert U.audit_high_repeat(audit, cut, ["t"]).where("high_repeat_group").count() == 5
    with pytest.raises(ValueError):
        U.high_repeat_threshold(audit, ["t"], "tuning")


def test_high_repeat_group_fallbacks(spark):
    raw = spark.createDataFrame([("t", i, i, "held_out", 0, 10 + i) for i in range(4)], "task string, row_id long, subject_id long, split string, label int, seq_len int")
    short = raw.withColumn("seq_len", F.lit(10))
    got = {r["row_id"]: (r["repeat_removed_proxy"], r["high_repeat_group"]) for r in U.high_repeat_group(raw, short, ["t"]).collect()}
    assert got == {0: (0.0, False), 1: (1.0, False), 2: (2.0, False), 3: (3.0, True)}
    assert U.high_repeat_group(raw, None, ["t"]).where("high_repeat_group").count() == 4


def test_codes(spark):
    events = spark.createDataFrame(
        [(c, s, d) for c, s, d in [("ICD/a", 1, 9.0), ("ICD/a", 1, 4.0), ("ICD/a", 2, 3.0), ("ICD/b", 1, 1.0), ("LAB/ICD", 1, 1.0)]],
        "code string, subject_id long, day double",
    )
    stats = {r["code"]: r for r in C.infer_persistent_codes(C.diagnosis_flag(events), 2, 1.5, 2.0).collect()}
    assert set(stats) == {"ICD/a", "ICD/b"}
    a = stats["ICD/a"]
    assert (a["n_subjects"], a["n_repeated_subjects"], a["mean_occurrences_per_subject"], a["median_span_days"], a["p75_span_days"]) == (2, 1, 1.5, 2.5, 3.75)
    assert a["selected_for_compression"] and not stats["ICD/b"]["selected_for_compression"]
    everything = C.infer_persistent_codes(C.diagnosis_flag(events), 99, 99.0, 99.0, keep_all=True)
    assert everything.where("not selected_for_compression").isEmpty()
    listed = spark.createDataFrame([(" icd/A ",), ("<UNK>",)], "code string")
    flags = C.diagnosis_flag(spark.createDataFrame([("ICD/a",), ("<unk>",), ("ICD/b",)], "code string"), listed)
    assert [r["is_diagnosis"] for r in flags.collect()] == [True, False, False]
    with pytest.raises(ValueError):
        C.whitelist_codes(listed, None, "weak")


def test_vocab(spark):
    source = spark.createDataFrame([("x", 5), ("<UNK>", 1)], "code string, token_id int")
    events = spark.createDataFrame([(c,) for c in ["b", "a", "c", "c", "x"]], "code string")
    got = {r["code"]: r["token_id"] for r in T.build_vocab(events, source).collect()}
    assert got == {"x": 5, "<UNK>": 1, "<PAD>": 0, "c": 6, "a": 7, "b": 8}
    taken = spark.createDataFrame([("x", 0)], "code string, token_id int")
    assert {r["code"]: r["token_id"] for r in T.build_vocab(events, taken).collect()} == {"x": 0, "<UNK>": 1, "c": 2, "a": 3, "b": 4}
    ids = T.encode_tokens(spark.createDataFrame([("x",), ("zzz",)], "code string"), source)
    assert [r["token_id"] for r in ids.orderBy("code").collect()] == [5, 1]
    back = T.decode_tokens(spark.createDataFrame([(5,), (77,)], "token_id int"), source)
    assert {r["token_id"]: r["code"] for r in back.collect()} == {5: "x", 77: "<UNK>"}


def test_token_stats_and_zscores(spark):
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "code string, token_id int")
    rows = [(0, 1.0), (0, 2.0), (0, 6.0), (0, None), (1, 4.0), (1, 4.0), (2, 3.0), (2, 3.0), (2, 3.0)]
    events = spark.createDataFrame(rows, "token_id int, num double")
    stats = {r["token_id"]: r for r in T.token_numeric_stats(events, vocab).collect()}
    assert (stats[0]["numeric_count_train"], stats[0]["numeric_mean_train"]) == (3, 3.0)
    assert stats[0]["numeric_std_train"] == pytest.approx((14 / 3) ** 0.5)
    assert (stats[1]["numeric_mean_train"], stats[1]["numeric_std_train"], stats[1]["has_enough_numeric_stats"]) == (0.0, 1.0, False)
    assert stats[2]["numeric_std_train"] == pytest.approx(1e-3) and stats[3]["numeric_count_train"] == 0
    z = T.numeric_zscore(spark.createDataFrame([(2, 9.0), (0, None), (1, 4.0)], "token_id int, num double"), T.token_numeric_stats(events, vocab))
    assert {r["token_id"]: (r["z"], r["present"]) for r in z.collect()} == {2: (10.0, 1.0), 0: (0.0, 0.0), 1: (4.0, 1.0)}


def test_leakage_is_checked_before_clamping(spark):
    df = spark.createDataFrame([(1, [3.0, -0.5]), (2, [])], "row_id int, days_before_prediction array<double>")
    assert X.leakage_check(df).first()["has_future_events"]
    with pytest.raises(ValueError, match="-0.5"):
        X.assert_no_future_events(df)
    assert X.assert_no_future_events(df.where("row_id = 2")).count() == 1


def test_subsample_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    one = X.seeded_subsample(df, 777, 3)
    assert one.count() == 777 and one.exceptAll(X.seeded_subsample(df.repartition(7), 777, 3)).isEmpty()
    assert not one.exceptAll(X.seeded_subsample(df, 777, 4)).isEmpty()
    assert X.seeded_subsample(df, 9999, 3).count() == 5000


def test_seed_summary_leaves_out_null_keys(spark):
    rows = [("a", 1, 0.5), ("a", 2, 0.7), (None, 1, 0.1), ("b", 1, 0.3)]
    df = spark.createDataFrame(rows, "k string, seed int, auroc double")
    got = {r["k"]: r for r in A.seed_summary(df, ["k"], ["auroc"]).collect()}
    assert set(got) == {"a", "b"} and got["b"]["auroc__std"] is None and got["a"]["n_seeds"] == 2


def test_means_do_not_depend_on_order(spark):
    rows = [(i, s, r) for i, perm in enumerate(([0.1, 0.2, 0.3], [0.3, 0.1, 0.2], [0.2, 0.3, 0.1])) for s, r in enumerate(perm)]
    df = spark.createDataFrame(rows, "id int, seed int, risk double")
    means = {r[1] for r in df.groupBy("id").agg(A.steady_mean("risk")).collect()}
    assert len(means) == 1


def test_usable_columns(spark):
    df = spark.createDataFrame([(1.0, None, 2.0, float("nan")), (2.0, None, 2.0, 1.0)], "a double, b double, c double, d double")
    assert W.usable_columns(df, ["a", "b", "c", "d"]) == ["a"]
    with pytest.raises(ValueError):
        W.usable_columns(df, ["b", "c"])
    with pytest.raises(ValueError):
        W.variant_columns(["x"], ["tabular"])


def test_vocab_files(spark, tmp_path):
    (tmp_path / "forward.json").write_text('{"a": 3, "b": 4}')
    (tmp_path / "backward.json").write_text('{"3": "a", "4": "b"}')
    (tmp_path / "list.json").write_text("[1, 2]")
    for name in ("forward", "backward"):
        got = R.read_vocab(spark, str(tmp_path / f"{name}.json")).collect()
        assert sorted(map(tuple, got)) == [("a", 3), ("b", 4)]
    with pytest.raises(Exception, match="JSON object"):
        R.read_vocab(spark, str(tmp_path / "list.json")).collect()


def test_code_list_columns(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("note,medical_code\n1, A \n2,\n3,B\n")
    (tmp_path / "bad.csv").write_text("note,label\n1,A\n")
    assert sorted(r["code"] for r in R.read_code_whitelist(spark, str(tmp_path / "ok.csv"), "s").collect()) == ["A", "B"]
    with pytest.raises(ValueError, match="medical_code"):
        R.read_code_whitelist(spark, str(tmp_path / "bad.csv"), "s")


def test_prediction_files_are_checked(spark, tmp_path):
    (tmp_path / "p.csv").write_text("task,row_id\nt,1\n")
    with pytest.raises(ValueError, match="subject_id.*variant"):
        R.read_predictions(spark, str(tmp_path / "p.csv"))


def test_example_dataset_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([("t", v, i) for v in ("raw", "x") for i in range(3)], "task string, version string, row_id long")
    Q.write_examples(df, str(tmp_path / "ex"))
    back = R.read_examples(spark, str(tmp_path / "ex"), version="raw").select("row_id")
    plan = back._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(version" in plan and "ReadSchema: struct<row_id:bigint>" in plan
    assert back.count() == 3
    with pytest.raises(ValueError):
        Q.write_table(df, str(tmp_path / "y"), "xlsx")


def test_dedup_does_not_carry_the_order_beside_the_row(spark):
    rows = [(1, "a", 0, "x"), (1, "b", 1, "w"), (1, "c", 1, "v"), (2, "d", 0, "z")]
    df = spark.createDataFrame(rows, "k int, v string, n int, path string")
    last, first = J.dedup(df, ["k"], ["n", "path"]), J.dedup(df, ["k"], ["n", "path"], "first")
    assert last.columns == df.columns and sorted(last.collect()) == [(1, "b", 1, "w"), (2, "d", 0, "z")]
    assert sorted(first.collect()) == [(1, "a", 0, "x"), (2, "d", 0, "z")]
    plan = last.select("k", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert [line.count("path#") for line in plan.splitlines() if "max_by" in line] == [1]
