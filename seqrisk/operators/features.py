"""Feature tables for the fusion models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrisk.functions.scalars import safe_float
from seqrisk.schemas import HELD_OUT, TABULAR_META, TUNING

# Column prefixes and the feature groups of each variant.
PREFIXES = {
    "tabular": "tab__",
    "sequence_embedding": "seq_emb__",
    "numeric_sequence_embedding": "numseq_emb__",
}
FEATURE_VARIANTS = {
    "tabular_features_only": ["tabular"],
    "sequence_embedding_only": ["sequence_embedding"],
    "numeric_sequence_embedding_only": ["numeric_sequence_embedding"],
    "tabular_plus_sequence_embedding": ["tabular", "sequence_embedding"],
    "tabular_plus_numeric_sequence_embedding": ["tabular", "numeric_sequence_embedding"],
    "tabular_plus_sequence_numeric_embeddings": [
        "tabular",
        "sequence_embedding",
        "numeric_sequence_embedding",
    ],
}
MIN_STD = 1e-12


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in TABULAR_META]


def prefix_features(df: DataFrame, seed: int) -> DataFrame:
    """Tuning and held-out rows with features renamed to ``tab__0000…``."""
    renamed = [F.col(c).alias(f"tab__{i:04d}") for i, c in enumerate(feature_columns(df))]
    return df.where(F.col("split").isin(TUNING, HELD_OUT)).select(
        "task",
        "split",
        F.lit(seed).alias("seed"),
        F.col("row_id").cast("long").alias("row_id"),
        F.col("subject_id").cast("long").alias("subject_id"),
        F.col("label").cast("int").alias("y_true"),
        *renamed,
    )


def unpack_embedding(df: DataFrame, column: str, size: int, prefix: str) -> DataFrame:
    """Embedding array to one column per position."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[F.get(column, i).alias(f"{prefix}{i:04d}") for i in range(size)])


def feature_groups(columns: Sequence[str]) -> dict[str, list[str]]:
    return {g: [c for c in columns if c.startswith(p)] for g, p in PREFIXES.items()}


def variant_columns(columns: Sequence[str], groups: Sequence[str]) -> list[str]:
    found = feature_groups(columns)
    out = [c for g in groups for c in found[g]]
    if not out:
        raise ValueError(f"No columns resolved for groups={list(groups)}")
    return out


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n_finite, std, usable) for all columns from one pass over the rows."""
    aggs = []
    for i, c in enumerate(columns):
        v = safe_float(c)
        aggs += [F.count(v).alias(f"n_{i}"), F.stddev_pop(v).alias(f"s_{i}")]
    each = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"n_{i}").alias("n_finite"),
                F.col(f"s_{i}").alias("std"),
                F.coalesce((F.col(f"n_{i}") > 0) & (F.col(f"s_{i}") > MIN_STD), F.lit(False)).alias("usable"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(*aggs).select(F.inline(each))


def usable_columns(train: DataFrame, columns: Sequence[str]) -> list[str]:
    """Features with a finite training value and some spread; one row per feature is read back."""
    usable = {r["feature"] for r in column_profile(train, columns).where("usable").collect()}
    if not usable:
        raise ValueError("No usable feature columns after dropping empty and constant columns")
    return [c for c in columns if c in usable]


def usable_places(train: DataFrame, column: str) -> list[int]:
    """``usable_columns`` for the places of an array of clean numbers; entries are counted map-side."""
    each = train.select(F.posexplode(column).alias("place", "v")).groupBy("place")
    rows = each.agg(F.count("v").alias("n"), F.stddev_pop("v").alias("std")).where((F.col("n") > 0) & (F.col("std") > MIN_STD))
    found = sorted(r["place"] for r in rows.collect())
    if not found:
        raise ValueError("No usable feature columns after dropping empty and constant columns")
    return found


def balanced_weights(df: DataFrame, keys: Sequence[str] = (), label: str = "y_true") -> DataFrame:
    """Per group: class counts (at least 1) and the weight of each class.

    The weight is n / (classes present · rows of the class).
    """
    n_pos = F.count_if(F.col(label) == 1)
    n_neg = F.count_if(F.col(label) == 0)
    share = F.count(F.lit(1)) / F.count_distinct(label)
    return df.groupBy(*keys).agg(
        F.greatest(n_neg, F.lit(1)).alias("n_neg"),
        F.greatest(n_pos, F.lit(1)).alias("n_pos"),
        F.try_divide(share, n_neg).alias("weight_neg"),
        F.try_divide(share, n_pos).alias("weight_pos"),
    )


def feature_manifest(df: DataFrame) -> DataFrame:
    """Rows and feature counts per task and seed."""
    groups = feature_groups(df.columns)
    return df.groupBy("task", "seed").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.lit(len(c)).cast("long").alias(f"n_{g}_features") for g, c in groups.items()],
    )
