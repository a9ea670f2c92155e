"""Tables with a row per example are not gathered at the driver."""

import pytest
from pyspark.sql import functions as F

from seqrisk.operators import joins as J
from seqrisk.operators import subgroup as U
from seqrisk.plans import joins as P


def scores(spark, version):
    return spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, "s").otherwise("t").alias("task"), F.lit("m").alias("model"), F.lit(1).alias("seed"), F.lit("raw").alias("calibration"),
        F.lit(version).alias("version"), F.col("id").alias("row_id"), F.col("id").alias("subject_id"),
        (F.col("id") % 2).cast("int").alias("y_true"), (F.col("id") % 7 / 7.0).alias("risk"),
    )


def audit(spark):
    held = scores(spark, "raw").select("task", "row_id", "subject_id")
    measures = ["repeat_removed_first_last", "raw_sequence_length_non_static", "n_diag_codes_persistent_365d"]
    return held.select("*", (F.col("row_id") % 2 == 0).alias("high_repeat_group"), *[F.lit(1.0).alias(m) for m in measures])


@pytest.mark.parametrize("name", ["subgroup_join", "pairs", "aligned", "one_to_one"])
def test_joins_of_example_rows_are_merged(spark, name):
    a, b = scores(spark, "raw"), scores(spark, "short")
    joined = {
        "subgroup_join": lambda: U.subgroup_join(a, audit(spark), check=False),
        "pairs": lambda: J.paired_join(a, b),
        "aligned": lambda: J.align_to_baseline(a.unionByName(b), "raw"),
        "one_to_one": lambda: J.validated_left_join(a.select("row_id", "risk"), b.select("row_id", "version"), ["row_id"], True),
    }[name]()
    assert joined.count() == 20_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    joined.collect()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_task_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(U, "row_partitions", lambda df: P.row_partitions(df, each=1000))
    joined = U.subgroup_join(scores(spark, "raw"), audit(spark), check=False)
    sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2000


def test_rows_without_a_baseline_are_not_moved(spark, monkeypatch):
    monkeypatch.setattr(J, "row_partitions", lambda df: P.row_partitions(df, each=1000))
    a, b = scores(spark, "raw"), scores(spark, "short")
    alone = b.withColumn("model", F.lit("alone")).unionByName(b.withColumn("model", F.lit(None).cast("string")))
    joined = J.align_to_baseline(a.unionByName(b).unionByName(alone), "raw")
    rows = joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in rows) == 20_000 and max(r["n"] for r in rows) < 2000
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert "xxhash64" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.select("model").distinct().collect() == [("m",)]
    monkeypatch.setattr(J, "MAX_KEYS", 0)
    assert J.align_to_baseline(a.unionByName(b).unionByName(alone), "raw").exceptAll(joined).isEmpty()
