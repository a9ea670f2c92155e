"""From packed examples to a written dataset of several compressed versions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrisk.operators.filters import assert_no_future_events, split_filter
from seqrisk.operators.sequence import (
    ANCHOR_GAP_DAYS,
    STRETCH,
    collect_sequence,
    compress_versions,
    compression_audit,
    explode_events,
    flag_compressible,
)
from seqrisk.operators.vocab import build_vocabs, decode_tokens
from seqrisk.plans.joins import lookup_join, stored
from seqrisk.schemas import TRAIN, default_example_columns, require_columns
from seqrisk.sources.writers import write_examples, write_metadata

META = ["subject_id", "prediction_time", "label", "split"]
ARRAYS = {
    "codes": "array<string>",
    "token_ids": "array<int>",
    "days_before_prediction": "array<double>",
    "delta_days": "array<double>",
    "numeric_values": "array<double>",
}


@dataclass(frozen=True)
class BuiltVersions:
    """``examples`` per (task, row_id, version, segment), ``vocab`` and ``metadata`` per version."""

    examples: DataFrame
    vocab: DataFrame
    metadata: DataFrame

    def write(self, root: str) -> None:
        """``examples`` under ``task=…/version=…``, ``vocab`` and ``metadata`` by version."""
        write_examples(self.examples, f"{root}/examples")
        self.vocab.write.mode("overwrite").partitionBy("version").json(f"{root}/vocab")
        write_metadata(self.metadata, f"{root}/metadata")


def example_events(examples: DataFrame, keys: Sequence[str], vocab: DataFrame | None = None) -> DataFrame:
    """Events of packed examples; where only token ids are packed they are decoded by ``vocab``."""
    if "codes" in examples.columns:
        return explode_events(default_example_columns(examples), keys)
    require_columns(examples, ["token_ids"], "examples without codes")
    if vocab is None:
        raise ValueError("examples with token ids only need a vocabulary")
    as_text = examples.withColumn("codes", F.col("token_ids").cast("array<string>"))
    tokens = explode_events(default_example_columns(as_text), keys)
    decoded = decode_tokens(tokens.withColumn("token_id", F.col("code").cast("int")).drop("code"), vocab)
    return decoded.drop("token_id")


def build_versions(
    examples: DataFrame,
    vocab: DataFrame,
    codes: DataFrame,
    versions: Sequence[str],
    max_gap: float = ANCHOR_GAP_DAYS,
    stretch: int = STRETCH,
    keys: Sequence[str] = ("task", "row_id"),
) -> BuiltVersions:
    """Compress packed examples into every version, with token ids, gaps and audit counts.

    Raw days after the prediction are an error. The kept events are made and stored once; each
    version has a vocabulary of its own, grown from ``vocab`` by its training events. Every example has
    a row in every version, one with an empty history with empty arrays and length 0. A history longer
    than ``stretch`` has several rows (``segment``, ``first_pos``) that ``explode_events`` puts together again.
    """
    keys = list(keys)
    assert_no_future_events(examples)
    meta = [c for c in META if c in examples.columns]
    first = examples.where(F.coalesce("segment", F.lit(0)) == 0) if "segment" in examples.columns else examples
    shown = first.select(*keys, *meta)
    events = example_events(examples, keys, vocab)
    flagged = stored(flag_compressible(events, codes))
    kept = stored(compress_versions(flagged, versions, keys, max_gap))

    train = kept.join(split_filter(shown, TRAIN).select(*keys), keys, "left_semi")
    vocabs = stored(build_vocabs(train, vocab, ["version"]))
    table = vocabs.withColumnRenamed("version", "_version").withColumnRenamed("code", "_code").withColumnRenamed("token_id", "_id")
    coded = lookup_join(kept, table, (F.col("version") == F.col("_version")) & (F.col("code") == F.col("_code")), "left", at_hand=True)
    coded = coded.select(*kept.columns, F.coalesce("_id", F.lit(1)).cast("int").alias("token_id"))
    packed = collect_sequence(coded, [*keys, "version"], stretch, ["token_id"])

    audit = compression_audit(flagged, kept, keys, F.col("compressible"), shown, versions)
    every = shown.join(audit, keys).join(packed, [*keys, "version"], "left")
    out = every.withColumns(
        {
            **{c: F.coalesce(c, F.array().cast(kind)) for c, kind in ARRAYS.items()},
            "segment": F.coalesce("segment", F.lit(0)).cast("long"),
            "first_pos": F.coalesce("first_pos", F.lit(0)).cast("long"),
        }
    )
    listed = codes.select("code").distinct().agg(F.count(F.lit(1)).alias("n"))
    own = vocabs.groupBy("version").agg(F.count(F.lit(1)).alias("vocab_size"))
    metadata = (
        audit.groupBy("version")
        .agg(
            F.count(F.lit(1)).alias("n_examples"),
            F.sum("seq_len").alias("n_events"),
            F.sum("raw_seq_len").alias("n_events_raw"),
            F.sum("n_synthetic_events").alias("n_synthetic_events"),
        )
        .join(own, "version", "left")
        .withColumn("source_vocab_size", vocab.agg(F.count(F.lit(1)).alias("n")).scalar())
        .withColumn("n_chronic_codes_selected", listed.scalar())
    )
    return BuiltVersions(out, vocabs, metadata)
