"""Steps that sort wide rows keep their number of tasks, however well the rows compress."""

from pyspark.sql import functions as F

from seqrisk.operators import sequence as S


def test_anchors_are_searched_in_all_tasks(spark):
    rows = spark.range(400).select(
        F.col("id").alias("row_id"), F.lit(0.0).alias("idx"), F.lit("VISIT/OP").alias("code"), F.lit(1.0).alias("day")
    )
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = S.visit_bucket(rows, ["row_id"])
        tasks = found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(tasks) == 16 and sum(t["n"] for t in tasks) == 400


def test_audits_count_events_in_all_tasks(spark):
    rows = spark.range(400).select(
        F.col("id").alias("row_id"), F.col("id").alias("subject_id"), F.lit("t").alias("task"), F.lit("held_out").alias("split"),
        F.lit(0.0).alias("idx"), F.lit("ICD/a").alias("code"), F.lit(1.0).alias("day"), F.lit(1.0).alias("num"),
        F.lit(False).alias("synthetic"), F.lit(True).alias("compressible"),
    )
    keys = ["row_id", "subject_id", "task", "split"]
    audit = S.compression_audit(rows, S.compress_versions(rows, ["raw", "compressed_dedup"], keys), keys)
    assert audit.count() == 800 and audit.agg(F.sum("seq_len")).first()[0] == 800
    assert "REPARTITION_BY_NUM" in audit._jdf.queryExecution().optimizedPlan().toString() or "RepartitionByExpression" in audit._jdf.queryExecution().optimizedPlan().toString()
