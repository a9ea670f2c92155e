"""Declared schemas and the name checks that run before any job."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN, TUNING, HELD_OUT = "train", "tuning", "held_out"
ENSEMBLE_SEED = -1

# Columns of sequence datasets, prediction files and audit tables.
EXAMPLES = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("subject_id", T.LongType()),
        T.StructField("prediction_time", T.TimestampType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("split", T.StringType()),
        T.StructField("codes", T.ArrayType(T.StringType())),
        T.StructField("token_ids", T.ArrayType(T.IntegerType())),
        T.StructField("days_before_prediction", T.ArrayType(T.DoubleType())),
        T.StructField("delta_days", T.ArrayType(T.DoubleType())),
        T.StructField("numeric_values", T.ArrayType(T.DoubleType())),
        T.StructField("seq_len", T.IntegerType()),
        T.StructField("n_unique_tokens", T.IntegerType()),
        T.StructField("raw_seq_len", T.IntegerType()),
        T.StructField("n_events_removed_vs_raw", T.IntegerType()),
        T.StructField("n_synthetic_events", T.IntegerType()),
        T.StructField("n_diagnosis_like_events_raw", T.IntegerType()),
        T.StructField("n_compressible_chronic_events_raw", T.IntegerType()),
        T.StructField("segment", T.LongType()),
        T.StructField("first_pos", T.LongType()),
        T.StructField("task", T.StringType()),
        T.StructField("version", T.StringType()),
    ]
)

# Column order of a written sequence dataset; anything else follows.
EXAMPLE_ORDER = [
    "task", "row_id", "subject_id", "prediction_time", "label", "split", "codes", "token_ids",
    "days_before_prediction", "delta_days", "numeric_values", "seq_len", "n_unique_tokens",
    "raw_seq_len", "n_events_removed_vs_raw", "n_synthetic_events",
    "n_diagnosis_like_events_raw", "n_compressible_chronic_events_raw",
]
#: Where a row of a long history stands; absent or 0 for a history in one row.
SEGMENT_COLUMNS = ["segment", "first_pos"]

REQUIRED_EXAMPLE = ["row_id", "subject_id", "label", "split", "codes", "days_before_prediction"]

TABULAR_META = ["task", "row_id", "subject_id", "prediction_time", "label", "split"]

PREDICTIONS = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("calibration", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("subject_id", T.LongType()),
        T.StructField("y_true", T.IntegerType()),
        T.StructField("risk", T.DoubleType()),
    ]
)

FUSION_REQUIRED = ["task", "variant", "row_id", "subject_id", "y_true", "risk"]
VERSION_REQUIRED = [
    "task", "version", "model", "seed", "calibration", "row_id", "subject_id", "y_true", "risk",
]
PREDICTION_KEY = ["task", "version", "model", "seed", "calibration", "row_id", "subject_id"]

AUDIT_COLUMNS = [
    "task", "row_id", "subject_id", "split", "label", "repeat_removed_first_last",
    "raw_sequence_length_non_static", "n_diag_codes_persistent_365d",
]


def require_columns(df: DataFrame, required: Iterable[str], what: str = "input") -> DataFrame:
    """Fail on the analysed schema, naming every missing column."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def default_columns(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add each absent optional column; later defaults may refer to earlier ones."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


def default_example_columns(df: DataFrame, task: str | None = None) -> DataFrame:
    """Optional columns of a packed sequence table."""
    from seqrisk.functions.arrays import array_delta_days
    from seqrisk.functions.scalars import nonnegative_day

    days = F.transform(F.col("days_before_prediction"), nonnegative_day)
    return default_columns(
        df,
        {
            "task": F.lit(task),
            "numeric_values": F.transform(F.col("codes"), lambda _: F.lit(None).cast("double")),
            "delta_days": array_delta_days(days),
        },
    )


def default_cost_columns(df: DataFrame) -> DataFrame:
    """Optional audit counters: the raw length falls back to the version's own length."""
    synthetic = F.col("n_compression_events") if "n_compression_events" in df.columns else F.lit(0)
    return default_columns(
        df,
        {
            "raw_seq_len": F.col("seq_len"),
            "n_events_removed_vs_raw": F.col("raw_seq_len") - F.col("seq_len"),
            "n_synthetic_events": synthetic,
            "n_compressible_chronic_events_raw": F.lit(None).cast("int"),
        },
    )
