import math

import pytest
from pyspark.sql import functions as F

from seqrisk.functions import scalars as P
from seqrisk.functions.arrays import array_delta_days, normalize_arrays, tail, tail_truncate
from seqrisk.functions.codes import is_diagnosis_name, is_visit_anchor


def values(spark, fn, rows, kind):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_safe_float(spark):
    got = values(spark, P.safe_float, ["1.5", "x", "NaN", "inf", "-inf", None, " 2 "], "string")
    assert got == [1.5, None, None, None, None, None, 2.0]


def test_nonnegative_day(spark):
    assert values(spark, P.nonnegative_day, [-3.0, None, 4.0, float("nan")], "double") == [0, 0, 4, 0]


def test_parse_list_cell(spark):
    cells = ["[1, 2]", "('a', 'b',)", "[]", "plain", "", None, "[broken x]", "['only']", "()"]
    got = values(spark, P.parse_list_cell, cells, "string")
    assert got == [["1", "2"], ["a", "b"], [], ["plain"], [], [], ["[broken x]"], ["only"], []]


@pytest.mark.parametrize(
    "fn,inputs,expected",
    [
        (P.duration_bin, [-1, 0, 0.5, 30, 30.1, 90, 180, 365, 730, 731], ["0", "0", "1_30", "1_30", "31_90", "31_90", "91_180", "181_365", "366_730", "gt730"]),
        (P.count_bin, [0, 1, 2, 3, 5, 6, 10, 11], ["1", "1", "2", "3_5", "3_5", "6_10", "6_10", "gt10"]),
        (P.recency_bin, [0, 7, 8, 30, 31, 180, 365, 366], ["0_7", "0_7", "8_30", "8_30", "31_90", "91_180", "181_365", "gt365"]),
    ],
)
def test_bins(spark, fn, inputs, expected):
    assert values(spark, fn, [float(x) for x in inputs], "double") == expected


def test_probabilities(spark):
    assert values(spark, P.clip_prob, [-1.0, 0.3, 2.0], "double") == [1e-6, 0.3, 1 - 1e-6]
    assert values(spark, P.logit, [0.5], "double") == [0.0]
    low, = values(spark, P.sigmoid, [-1000.0], "double")
    assert low == pytest.approx(1 / (1 + math.exp(30)))
    assert values(spark, lambda x: P.sigmoid(x, None), [-1000.0], "double") == [0.0]
    with pytest.raises(ValueError):
        P.score_transform("x", "rank")


def test_labels(spark):
    assert values(spark, P.subgroup_label, [None, True, False], "boolean") == ["all", "high_repeat_top10", "other_90"]
    df = spark.createDataFrame([("a_numeric",), ("numeric_b",)], "m string")
    assert [tuple(r) for r in df.select(*P.split_model_name("m")).collect()] == [("a", True), ("numeric_b", False)]


def test_code_predicates(spark):
    codes = ["SNOMED/1", "icd10", "LOINC/ICD", "<UNK>", "DX/visit", "other", " Condition:x "]
    assert values(spark, is_diagnosis_name, codes, "string") == [True, True, False, False, False, False, True]
    names = ["VISIT", "visit/op", " Visit_x", "visit:1", "VISITOR", "REVISIT/"]
    assert values(spark, is_visit_anchor, names, "string") == [True, True, True, True, False, False]


def test_normalize_and_tail(spark):
    df = spark.createDataFrame(
        [(["a", "b", "c"], [5.0, -1.0], [1.0, 2.0, 3.0, 4.0], [7.0, float("nan")]), ([], [1.0], [], []), (None, None, None, None)],
        "codes array<string>, d array<double>, g array<double>, n array<double>",
    )
    got = [r[0] for r in df.select(normalize_arrays(F.col("codes"), F.col("d"), F.col("g"), F.col("n"))).collect()]
    assert [tuple(e) for e in got[0]] == [("a", 5.0, 1.0, 7.0), ("b", 0.0, 2.0, None), ("c", 0.0, 3.0, None)]
    assert got[1] == [] and got[2] == []
    short = spark.createDataFrame([([1, 2, 3],), ([1],), ([],)], "a array<int>")
    assert [r[0] for r in short.select(tail(F.col("a"), 2)).collect()] == [[2, 3], [1], []]
    empty = F.array().cast("array<double>")
    cut = [r[0] for r in short.select(tail_truncate(F.col("a"), empty, empty, empty, 2)).collect()]
    assert [[e["token_id"] for e in c] for c in cut] == [[2, 3], [1], [1]]
    assert tuple(cut[2][0]) == (1, 0.0, 0.0, None)


def test_delta_days(spark):
    got = values(spark, array_delta_days, [[5.0, 3.0, 4.0, 1.0], [], [2.0]], "array<double>")
    assert got == [[0.0, 2.0, 0.0, 3.0], [], [0.0]]
