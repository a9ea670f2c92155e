"""Inputs of the queries, derived from the given tables with Spark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrisk.operators.sequence import compress_versions, compression_audit, flag_compressible
from seqrisk.plans.joins import local_table
from seqrisk.plans.ordered import GROUP, dense_index, never_null

ANCHOR_GAP = 0.25
ERA_GAPS = (1, 3)
VERSIONS = ["raw", "compressed_dedup", "compressed_first_last", "condition_era_1", "state_duration_3"]
LISTED = ["SNOMED/error", "ICD/purchase", "ICD/never_seen"]
TASKS = ["routine", "urgent"]
SEEDS = (42, 43, 44)

# family, source, version, model, signal strength
MODELS = [
    ("tabular", "tabular", "tabular_all_features", "trees", 40),
    ("sequence", "sequence", "raw", "rnn", 10),
    ("sequence", "sequence", "compressed_dedup", "rnn", 20),
    ("numeric_sequence", "numeric_sequence", "compressed_dedup", "rnn_numeric", 25),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def code_list(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(c, "listed") for c in LISTED], "code string, selection_source string")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events as seen from two prediction points per user, before numbering."""
    kinds = {
        "view": "VISIT/OP", "error": "SNOMED/error", "purchase": "ICD/purchase",
        "click": "LOINC/click", "signup": "RXNORM/signup",
    }
    code = F.lit(None).cast("string")
    for kind, name in kinds.items():
        code = F.when(F.col("event_type") == kind, name).otherwise(code)
    points = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.to_timestamp(F.lit(t)).alias("prediction_time"))
            for k, t in ((1, "2024-01-16"), (2, "2024-01-31"))
        ]
    )
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"), "ts", "event_id", code.alias("code"), F.col("value").alias("num"),
        F.inline(points),
    )
    micros = F.unix_micros("prediction_time") - F.unix_micros(F.col("ts").cast("timestamp"))
    split = F.when(F.col("subject_id") % 10 <= 5, "train").when(F.col("subject_id") % 10 <= 7, "tuning")
    return rows.where(F.col("ts") < F.col("prediction_time")).select(
        (F.col("subject_id") * 10 + F.col("k")).alias("row_id"),
        "subject_id",
        F.when(F.col("k") == 1, "early").otherwise("late").alias("task"),
        split.otherwise("held_out").alias("split"),
        "ts",
        "event_id",
        "code",
        (micros / F.lit(86400000000.0)).alias("day"),
        "num",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered events; positions come from hourly counts, so no history is numbered in one task."""
    rows = event_rows(spark, sf_dir).withColumn(GROUP, F.struct("row_id"))
    hour = never_null(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)) / 3_600_000_000
    numbered = dense_index(rows, [F.asc("ts"), F.asc("event_id")], F.floor(hour), "idx")
    return numbered.select(
        "row_id", "subject_id", "task", "split", F.col("idx").cast("double").alias("idx"), "code", "day", "num",
        F.lit(False).alias("synthetic"),
    )


def flagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_compressible(events(spark, sf_dir), code_list(spark))


def example_labels(ev: DataFrame) -> DataFrame:
    """One row per prediction point; positive when the last event is an error or a purchase."""
    last = F.max_by("code", "idx").isin("SNOMED/error", "ICD/purchase").cast("int")
    return ev.groupBy("row_id", "subject_id", "task", "split").agg(last.alias("label"))


def audited_examples(spark: SparkSession, sf_dir: str, versions=tuple(VERSIONS)) -> DataFrame:
    """Compression audit of several versions beside the example columns."""
    flagged = flagged_events(spark, sf_dir)
    keys = ["row_id", "subject_id", "task", "split"]
    compressed = compress_versions(flagged, list(versions), keys, ANCHOR_GAP)
    audit = compression_audit(flagged, compressed, keys, F.col("compressible"))
    labels = example_labels(flagged).select("row_id", "label")
    return audit.join(labels.hint("merge"), "row_id")


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the events by name from id 2, with PAD and UNK."""
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    code = (
        F.when(F.col("event_type") == "view", "VISIT/OP")
        .when(F.col("event_type") == "error", "SNOMED/error")
        .when(F.col("event_type") == "purchase", "ICD/purchase")
        .when(F.col("event_type") == "click", "LOINC/click")
    )
    named = kinds.select(code.alias("code")).where(F.col("code").isNotNull())
    grouped = named.withColumn(GROUP, F.struct(F.lit(0).alias("_all")))
    numbered = dense_index(grouped, [F.asc("code")], F.lit(0), "i").select(
        "code", (F.col("i") + 2).cast("int").alias("token_id")
    )
    special = local_table(spark, [("<PAD>", 0), ("<UNK>", 1)], "code string, token_id int")
    return numbered.unionByName(special)


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences straight from the vectors: one position per number."""
    e = F.col("embedding")
    n = F.col("vec_id") % 7 * 9
    size = F.size(e)
    code = F.transform(
        F.slice(e, F.lit(1), n.cast("int")),
        lambda x: F.when(x < -0.1, "ICD/low").when(x < 0.0, "SNOMED/minus").when(x < 0.1, "VISIT/OP").otherwise("LOINC/high"),
    )
    half = F.transform(F.slice(e, F.lit(1), F.greatest(n - 2, F.lit(0)).cast("int")), lambda x, i: (size - i) / F.lit(2.0) - 1.0)
    subject = F.col("vec_id") % 50
    split = F.when(subject % 10 <= 5, "train").when(subject % 10 <= 7, "tuning").otherwise("held_out")
    return table(spark, sf_dir, "embeddings").select(
        F.lit("vectors").alias("task"),
        F.lit("raw").alias("version"),
        F.col("vec_id").alias("row_id"),
        subject.alias("subject_id"),
        (F.col("label") < 3).cast("int").alias("label"),
        split.alias("split"),
        code.alias("codes"),
        half.alias("days_before_prediction"),
        F.transform(F.slice(e, F.lit(1), F.lit(3)), lambda x: x.cast("double") * 10).alias("delta_days"),
        F.transform(e, lambda x: F.when(x >= -0.2, x.cast("double"))).alias("numeric_values"),
    )


def predictions(spark: SparkSession, sf_dir: str, seeds=SEEDS, models=tuple(MODELS)) -> DataFrame:
    """Scores of several models and seeds for every order."""
    runs = F.array(
        *[
            F.struct(
                F.lit(f).alias("family"), F.lit(s).alias("source"), F.lit(v).alias("version"),
                F.lit(m).alias("model"), F.lit(w).alias("w"), F.lit(seed).alias("seed"),
            )
            for f, s, v, m, w in models
            for seed in seeds
        ]
    )
    rows = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "urgent").otherwise("routine").alias("task"),
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("subject_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_true"),
        F.inline(runs),
    )
    noise = (F.col("row_id") * (F.col("seed") - 35)) % 101
    # Multiples of 1/256 add up without rounding, so equal means over seeds are equal on every engine.
    risk = (1 + noise + F.col("y_true") * F.col("w")) / F.lit(256.0)
    return rows.select(
        "task", "family", "source", "version", "model", "seed", F.lit("raw").alias("calibration"), "row_id",
        "subject_id", "y_true", risk.alias("risk"),
    )


def document_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tasks over labelled documents; the score is continuous in the text length."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").alias("chars"), F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("subject_id")
    )
    both = F.inline(
        F.array(
            F.struct(F.lit("quality").alias("task"), F.col("quality").alias("y_true")),
            F.struct(F.lit("toxic").alias("task"), F.col("toxic").alias("y_true")),
        )
    )
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select(
        F.col("doc_id").alias("row_id"),
        "subject_id",
        (F.col("chars") / (F.col("chars") + F.lit(2000.0))).alias("risk"),
        both,
    )


def history_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of every order: its line count stands for repeated events."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("m")
    )
    split = (
        F.when(F.col("o_custkey") % 10 <= 3, "train").when(F.col("o_custkey") % 10 <= 5, "tuning").otherwise("held_out")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "urgent").otherwise("routine").alias("task"),
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("subject_id"),
        split.alias("split"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )
    return orders.join(lines.hint("merge"), "row_id", "left").select(
        *orders.columns,
        F.coalesce(F.col("n") - 1, F.lit(0)).cast("double").alias("repeat_removed_first_last"),
        F.coalesce("n", F.lit(0)).cast("double").alias("raw_sequence_length_non_static"),
        F.coalesce("m", F.lit(0)).cast("double").alias("n_diag_codes_persistent_365d"),
    )


def base_scores(spark: SparkSession, sf_dir: str, seeds=(42, 43)) -> DataFrame:
    """Three base scores per order and seed, tuning and held-out."""
    split = F.when(F.col("o_custkey") % 10 <= 4, "tuning").otherwise("held_out")
    rows = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "urgent").otherwise("routine").alias("task"),
        split.alias("split"),
        F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"),
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("subject_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_true"),
    )

    def score(prime: int, w: int):
        noise = (F.col("row_id") * (F.col("seed") - prime)) % 101
        return (1 + noise + F.col("y_true") * w) / F.lit(256.0)

    return rows.select(
        "*", score(35, 40).alias("p_tabular"), score(31, 10).alias("p_sequence"), score(29, 20).alias("p_numeric_sequence")
    )


def fusion_predictions(spark: SparkSession, sf_dir: str, seeds=(42, 43)) -> DataFrame:
    """Long fusion predictions: one row per variant of the held-out base scores."""
    variants = F.inline(
        F.array(
            F.struct(F.lit("tabular_only").alias("variant"), F.col("p_tabular").alias("risk")),
            F.struct(F.lit("sequence_only").alias("variant"), F.col("p_sequence").alias("risk")),
            F.struct(
                F.lit("fusion_tabular_sequence").alias("variant"),
                ((F.col("p_tabular") + F.col("p_sequence")) / 2).alias("risk"),
            ),
        )
    )
    held = base_scores(spark, sf_dir, seeds).where(F.col("split") == "held_out")
    return held.select("task", "seed", "split", "row_id", "subject_id", "y_true", variants)


def tabular_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide features per prediction point, with one empty and one constant column."""
    ev = event_rows(spark, sf_dir)
    names = {"visit": "VISIT/OP", "error": "SNOMED/error", "purchase": "ICD/purchase", "click": "LOINC/click"}
    aggs = []
    for name, code in names.items():
        aggs += [
            F.count_if(F.col("code") == code).cast("double").alias(f"n_{name}"),
            F.avg(F.when(F.col("code") == code, F.col("num"))).alias(f"mean_{name}"),
        ]
    last = F.max_by("code", F.struct("ts", "event_id")).isin("SNOMED/error", "ICD/purchase").cast("int")
    rows = ev.groupBy("task", "row_id", "subject_id", "split").agg(last.alias("label"), *aggs)
    return rows.withColumn("empty", F.lit(None).cast("double")).withColumn("constant", F.lit(1.0))


#: Width of the vectors in the given table.
WIDTH = 64


def embedding_features(spark: SparkSession, sf_dir: str, seeds=(42, 43)) -> DataFrame:
    """Feature table of the fusion models: three ``tab__`` columns and two embedding arrays."""
    e = F.col("embedding")
    split = F.when(F.col("vec_id") % 50 % 2 == 0, "tuning").otherwise("held_out")
    return table(spark, sf_dir, "embeddings").select(
        F.lit("vectors").alias("task"),
        split.alias("split"),
        F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"),
        F.col("vec_id").alias("row_id"),
        (F.col("vec_id") % 50).alias("subject_id"),
        (F.col("label") < 3).cast("int").alias("y_true"),
        (F.col("label") + F.col("vec_id") % 3).cast("double").alias("tab__0000"),
        F.lit(1.0).alias("tab__0001"),
        F.when(F.col("vec_id") % 4 != 0, (F.col("vec_id") % 11).cast("double")).alias("tab__0002"),
        e,
    ).select(
        "task", "split", "seed", "row_id", "subject_id", "y_true", "tab__0000", "tab__0001", "tab__0002",
        F.transform("embedding", lambda x: x.cast("double") + F.col("seed") * 0.01).alias("seq_emb"),
        F.transform("embedding", lambda x: x.cast("double") * x.cast("double") - F.col("seed") * 0.01).alias("numseq_emb"),
    )
