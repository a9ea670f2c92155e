"""Writers. Nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrisk.schemas import EXAMPLE_ORDER

FORMATS = ["csv", "csv.gz", "parquet"]


def write_examples(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Sequence dataset under ``task=…/version=…``, preferred columns first.

    With dynamic partition overwrite a rerun replaces only the versions it holds.
    """
    first = [c for c in EXAMPLE_ORDER if c in df.columns]
    rest = [c for c in df.columns if c not in EXAMPLE_ORDER]
    (
        df.select(*first, *rest)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("task", "version")
        .parquet(root)
    )


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    if kind not in FORMATS:
        raise ValueError(f"Unknown table format: {kind}")
    writer = df.write.mode(mode)
    if kind == "parquet":
        writer.parquet(path)
    else:
        codec = "gzip" if kind == "csv.gz" else "none"
        writer.option("header", True).option("compression", codec).csv(path)


def write_vocab(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vocabulary as JSON lines of (code, token_id)."""
    vocab.select("code", "token_id").write.mode(mode).json(path)


def vocab_document(vocab: DataFrame) -> DataFrame:
    """The vocabulary as one JSON object, code → id; as large as the vocabulary."""
    entries = F.sort_array(F.collect_list(F.struct("token_id", "code")))
    pairs = F.transform(entries, lambda e: F.struct(e["code"].alias("key"), e["token_id"].alias("value")))
    return vocab.agg(F.to_json(F.map_from_entries(pairs)).alias("value"))


def write_metadata(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One-row description of a dataset as JSON."""
    df.write.mode(mode).json(path)
