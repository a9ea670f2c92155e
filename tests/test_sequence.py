"""Compression against direct per-example loops written from the operator definitions."""

import random

import pytest
from pyspark.sql import functions as F

from seqrisk.functions.codes import is_visit_anchor
from seqrisk.operators import sequence as S

CODES = ["A", "B", "C", "VISIT/X", "VISIT/Y"]
LISTED = {"A", "B", "VISIT/Y"}
SCHEMA = "row_id long, idx double, code string, day double, num double, synthetic boolean"


def histories(seed, n=25, length=40):
    """Falling days with ties, out-of-order days and anchors that share a day."""
    rng = random.Random(seed)
    out = []
    for row in range(n):
        day = 60.0
        for i in range(rng.randint(1, length)):
            day = max(0.0, day - rng.choice([0, 0, 0.5, 1, 1, 2, 5, -1]))
            out.append((row, float(i), rng.choice(CODES), day, rng.choice([None, 1.0, 2.5]), False))
    return out


def nearest(event, anchors, gap):
    near = [a for a in anchors if abs(a[3] - event[3]) <= gap]
    return min(near, key=lambda a: (abs(a[3] - event[3]), abs(a[1] - event[1]), a[1]), default=None)


def visits(events, gap):
    anchors = [e for e in events if e[2].startswith("VISIT")]
    out = {}
    for e in events:
        a = e if e in anchors else nearest(e, anchors, gap)
        out[e[1]] = f"visit::{int(a[1])}" if a else f"day::{round(e[3])}"
    return out


def shorten(events, version, gap):
    bucket = visits(events, gap)
    seen, kept = set(), []
    for e in events:
        key = (e[2], bucket[e[1]])
        if e[2] in LISTED and key in seen:
            continue
        seen.add(key)
        kept.append(e)
    if version == "compressed_dedup":
        return kept
    row = events[0][0]
    out = [e for e in kept if e[2] not in LISTED]
    for code in LISTED:
        es = [e for e in kept if e[2] == code]
        if version == "compressed_first_last":
            eras = [es] if es else []
        else:
            limit, eras = int(version.rsplit("_", 1)[1]), []
            for e in es:
                if eras and max(eras[-1][-1][3] - e[3], 0) <= limit:
                    eras[-1].append(e)
                else:
                    eras.append([e])
        for era in eras:
            if len(era) == 1:
                out.append(era[0])
                continue
            a, b, n = era[0], era[-1], len(era)
            span, count = max(a[3] - b[3], 0.0), "1" if n < 2 else "2" if n == 2 else "3_5" if n <= 5 else "6_10" if n <= 10 else "gt10"
            if version == "compressed_first_last":
                new = [(a[1], f"DX_FIRST/{code}", a[3], 0.0), (b[1], f"DX_LAST/{code}", b[3], span)]
            elif version.startswith("condition"):
                p = f"DX_ERA{limit}"
                new = [
                    (a[1], f"{p}_START/{code}", a[3], 0.0), (b[1] + 1e-4, f"{p}_END/{code}", b[3], span),
                    (b[1] + 2e-4, f"{p}_COUNT_BIN/{count}/{code}", b[3], float(n)),
                ]
            else:
                p = f"DX_STATE{limit}"
                dur = "0" if span <= 0 else "1_30" if span <= 30 else "31_90"
                rec = "0_7" if b[3] <= 7 else "8_30" if b[3] <= 30 else "31_90"
                new = [
                    (a[1], f"{p}_ONSET/{code}", a[3], 0.0), (b[1] + 1e-4, f"{p}_ACTIVE/{code}", b[3], float(n)),
                    (b[1] + 2e-4, f"{p}_DURATION_BIN/{dur}/{code}", b[3], span), (b[1] + 3e-4, f"{p}_COUNT_BIN/{count}/{code}", b[3], float(n)),
                    (b[1] + 4e-4, f"{p}_RECENCY_BIN/{rec}/{code}", b[3], b[3]),
                ]
            out += [(row, i, c, d, v, True) for i, c, d, v in new]
    return out


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def flagged(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("compressible", F.col("code").isin(*LISTED))


def rounded(rows):
    return sorted((r[0], round(r[1], 6), r[2], r[3], -1.0 if r[4] is None else r[4], r[5]) for r in rows)


@pytest.mark.parametrize("gap", [0.0, 1.0, 3.0])
def test_nearest_anchor(spark, gap):
    rows = histories(5)
    df = spark.createDataFrame(rows, SCHEMA)
    anchor = is_visit_anchor(F.col("code"))
    got = {(r["row_id"], r["idx"]): r["anchor_idx"] for r in S.nearest_anchor(df, anchor, ~anchor, max_gap=gap).collect()}
    want = {}
    for row, events in grouped(rows).items():
        anchors = [e for e in events if e[2].startswith("VISIT")]
        for e in events:
            if e not in anchors:
                found = nearest(e, anchors, gap)
                want[(row, e[1])] = found[1] if found else None
    assert got == want


@pytest.mark.parametrize("version", ["compressed_dedup", "compressed_first_last", "condition_era_2", "state_duration_1"])
@pytest.mark.parametrize("gap", [0.5, 2.0])
def test_versions(spark, version, gap):
    rows = histories(11)
    got = [tuple(r) for r in S.compress(flagged(spark, rows), version, max_gap=gap).select("row_id", *S.EVENT).collect()]
    want = [e for events in grouped(rows).values() for e in shorten(events, version, gap)]
    assert rounded(got) == rounded(want)


def test_raw_is_identity_and_dedup_is_idempotent(spark):
    df = flagged(spark, histories(3))
    raw = S.compress(df, "raw")
    assert raw.exceptAll(df.drop("compressible")).isEmpty() and raw.count() == df.count()
    once = S.compress(df, "compressed_dedup", max_gap=1.0)
    twice = S.compress(once.withColumn("compressible", F.col("code").isin(*LISTED)), "compressed_dedup", max_gap=1.0)
    assert sorted(map(tuple, once.select("row_id", "idx").collect())) == sorted(map(tuple, twice.select("row_id", "idx").collect()))


def test_other_codes_survive_every_version(spark):
    df = flagged(spark, histories(4))
    want = df.where("not compressible").count()
    versions = ["raw", "compressed_dedup", "compressed_first_last", "condition_era_2", "state_duration_2"]
    out = S.compress_versions(df, versions)
    got = {r["version"]: r["count"] for r in out.where("not synthetic and code = 'C' or code = 'VISIT/X'").groupBy("version").count().collect()}
    assert got == {v: want for v in versions}


def test_unknown_version(spark):
    with pytest.raises(ValueError):
        S.compress(flagged(spark, histories(1, 1)), "shuffled")


def test_era_limit_stays_and_compression_can_lengthen(spark):
    rows = [(1, 0.0, "A", 10.0, None, False), (1, 1.0, "A", 8.0, None, False), (1, 2.0, "A", 5.0, None, False)]
    eras = {r["idx"]: r["era"] for r in S.split_eras(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert eras == {0.0: 0, 1.0: 0, 2.0: 1}
    df = flagged(spark, rows[:2])
    out = S.compress(df, "state_duration_90", max_gap=0.1)
    audit = S.compression_audit(df, out.withColumn("version", F.lit("v"))).first()
    assert audit["n_events_removed_vs_raw"] == -3 and audit["n_synthetic_events"] == 5


def test_long_histories_are_cut_without_changing_results(spark):
    """Stretches of 4 positions give the same eras, gaps and sequences as whole histories."""
    df = spark.createDataFrame(histories(8), SCHEMA)
    a = S.split_eras(df, 1, stretch=4).select("row_id", "idx", "era")
    assert a.exceptAll(S.split_eras(df, 1).select("row_id", "idx", "era")).isEmpty()
    assert S.delta_days(df, stretch=4).exceptAll(S.delta_days(df)).isEmpty()
    cut = S.collect_sequence(df, stretch=4)
    assert cut.agg(F.max(F.size("codes"))).first()[0] <= 4
    joined = cut.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("segment", "codes", "delta_days"))).alias("s"))
    joined = joined.select("row_id", F.flatten("s.codes").alias("codes"), F.flatten("s.delta_days").alias("delta_days"))
    assert joined.exceptAll(S.collect_sequence(df).select("row_id", "codes", "delta_days")).isEmpty()


def test_one_history_with_most_rows(spark):
    """A single example with far more events than all others gives the same result as alone."""
    rng = random.Random(9)
    big = [(99, float(i), rng.choice(CODES), 3000.0 - i * 0.3, 1.0, False) for i in range(4000)]
    rows = big + histories(10, 10)
    got = S.compress(flagged(spark, rows), "condition_era_2", max_gap=1.0).where("row_id = 99").select("row_id", *S.EVENT).collect()
    assert rounded(map(tuple, got)) == rounded(shorten(big, "condition_era_2", 1.0))
