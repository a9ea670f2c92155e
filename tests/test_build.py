"""Packed histories: cut, read back, built into versions."""

import pytest
from pyspark.sql import functions as F

from seqrisk.operators import sequence as S
from seqrisk.operators.build import build_versions

SCHEMA = "task string, row_id long, subject_id long, label int, split string, codes array<string>, days_before_prediction array<double>"


def examples(spark):
    rows = [
        ("t", 1, 1, 0, "train", ["A", "V", "A", "B", "A", "A", "B"], [9.0, 8.0, 8.0, 7.0, 3.0, 2.0, 1.0]),
        ("t", 2, 2, 1, "train", [], []),
        ("t", 3, 3, 1, "held_out", ["C"], [0.5]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def vocab(spark):
    return spark.createDataFrame([("A", 2), ("B", 3), ("<PAD>", 0), ("<UNK>", 1)], "code string, token_id int")


def listed(df):
    return sorted(map(repr, df.select("row_id", "idx", "code", "day", "num").collect()))


@pytest.mark.parametrize("stretch", [1, 3, 4, S.STRETCH])
def test_round_trip_at_any_stretch(spark, stretch):
    events = S.explode_events(examples(spark))
    again = S.explode_events(S.collect_sequence(events, stretch=stretch))
    assert listed(again) == listed(events)
    deltas = {(r["row_id"], r["idx"]): r["delta"] for r in S.delta_days(events, stretch=stretch).collect()}
    assert deltas == {(r["row_id"], r["idx"]): r["delta"] for r in S.delta_days(events).collect()}


@pytest.mark.parametrize("length", [1, 2, 5, 50])
def test_tail_of_the_whole_history(spark, length):
    packed = S.collect_sequence(S.explode_events(examples(spark)), stretch=3)
    got = {r["row_id"]: r["codes"] for r in S.history_tail(packed, length).collect()}
    assert got == {1: ["A", "V", "A", "B", "A", "A", "B"][-length:], 3: ["C"]}


def test_empty_histories_stay(spark):
    codes = spark.createDataFrame([("A",)], "code string")
    built = build_versions(examples(spark), vocab(spark), codes, ["raw", "compressed_first_last"])
    rows = {(r["row_id"], r["version"]): r for r in built.examples.collect()}
    assert len(rows) == 6
    assert rows[2, "raw"]["codes"] == [] and rows[2, "raw"]["seq_len"] == 0 and rows[2, "raw"]["label"] == 1
    assert rows[3, "raw"]["token_ids"] == [1]  # C is in no training example
    short = rows[1, "compressed_first_last"]
    assert short["codes"][0] == "DX_FIRST/A" and short["seq_len"] == len(short["codes"]) == len(short["delta_days"])
    ids = {r["code"]: r["token_id"] for r in built.vocab.where("version = 'compressed_first_last'").collect()}
    assert short["token_ids"] == [ids[c] for c in short["codes"]]
    assert {r["version"]: r["n_chronic_codes_selected"] for r in built.metadata.collect()} == {"raw": 1, "compressed_first_last": 1}


def test_future_events_are_an_error(spark):
    bad = examples(spark).withColumn("days_before_prediction", F.transform("days_before_prediction", lambda d: d - 5))
    with pytest.raises(ValueError, match="future"):
        build_versions(bad, vocab(spark), spark.createDataFrame([("A",)], "code string"), ["raw"])


def test_examples_with_token_ids_only(spark):
    ids = examples(spark).withColumn("token_ids", F.transform("codes", lambda c: F.when(c == "A", 2).when(c == "B", 3).otherwise(77)))
    built = build_versions(ids.drop("codes"), vocab(spark), spark.createDataFrame([("A",)], "code string"), ["raw"])
    got = {r["row_id"]: r["codes"] for r in built.examples.collect()}
    assert got == {1: ["A", "<UNK>", "A", "B", "A", "A", "B"], 2: [], 3: ["<UNK>"]}
