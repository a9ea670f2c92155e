"""The build of compressed datasets: written, read back, and compared element by element."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query, scratch
from catalog.sql import cols, with_views
from seqrisk.operators import sequence as S
from seqrisk.operators.build import build_versions
from seqrisk.plans.joins import local_table
from seqrisk.sources import readers as R

# The packed view holds empty histories; these codes of it are compressible.
CODES = ["ICD/low", "SNOMED/minus"]
SWAP = {
    "v_events": (
        ["v_packed_events"],
        "SELECT row_id, subject_id, task, split, idx::DOUBLE AS idx, code, day, num, FALSE AS synthetic FROM v_packed_events",
    ),
    "v_flagged": (["v_events"], "SELECT *, code IN ('ICD/low','SNOMED/minus') AS compressible FROM v_events"),
}
_TRAIN = "v_versions v JOIN (SELECT row_id FROM v_packed WHERE split='train') l USING (row_id)"
_VOCABS = f"""b_names AS (SELECT DISTINCT version FROM {_TRAIN}),
b_vocab AS (SELECT version, code, token_id::BIGINT AS token_id FROM v_vocab, b_names UNION ALL
 SELECT version, code, ((SELECT max(token_id) FROM v_vocab)+row_number() OVER (PARTITION BY version ORDER BY n DESC, code))::BIGINT FROM (
 SELECT v.version, v.code, count(*) AS n FROM {_TRAIN} WHERE v.code NOT IN (SELECT code FROM v_vocab) GROUP BY ALL))"""
_READ = ("v_versions", "v_packed", "v_vocab", "v_flagged")


def _built(spark, sf_dir, stretch=S.STRETCH):
    codes = local_table(spark, [(c,) for c in CODES], "code string")
    return build_versions(V.packed(spark, sf_dir).drop("version"), V.vocab(spark, sf_dir), codes, V.VERSIONS, V.ANCHOR_GAP, stretch)


def _elements(spark, sf_dir, stretch):
    root = scratch(spark, "build")
    _built(spark, sf_dir, stretch).write(root)
    back = R.read_examples(spark, f"{root}/examples", "vectors")
    zipped = F.arrays_zip("codes", "token_ids", "days_before_prediction", "delta_days", "numeric_values")
    rows = back.select("version", "row_id", "first_pos", F.posexplode(zipped).alias("p", "e"))
    return rows.select(
        "version", "row_id", (F.col("first_pos") + F.col("p")).alias("pos"), F.col("e.codes").alias("code"),
        F.col("e.token_ids").alias("token_id"), F.col("e.days_before_prediction").alias("day"),
        F.col("e.delta_days").alias("delta"), F.col("e.numeric_values").alias("num"),
    )


_ELEMENTS = with_views(
    "SELECT " + cols("version code", "row_id pos token_id", "day delta num")
    + """ FROM (SELECT v.version, v.row_id, v.code, coalesce(b.token_id, 1) AS token_id, day, num,
 row_number() OVER (PARTITION BY v.version, v.row_id ORDER BY idx)-1 AS pos,
 coalesce(greatest(lag(day) OVER (PARTITION BY v.version, v.row_id ORDER BY idx)-day, 0), 0) AS delta
 FROM v_versions v LEFT JOIN b_vocab b ON v.version=b.version AND v.code=b.code)""",
    *_READ, extra=_VOCABS, swap=SWAP,
)


@query("build_versions", _ELEMENTS)
def versions(spark, sf_dir):
    """Every element of every array of the written dataset."""
    return _elements(spark, sf_dir, S.STRETCH)


@query("build_versions_segments", _ELEMENTS)
def versions_in_segments(spark, sf_dir):
    """The same dataset with histories cut after every four positions."""
    return _elements(spark, sf_dir, 4)


_COUNTS = "seq_len n_unique_tokens raw_seq_len n_events_removed_vs_raw n_synthetic_events n_diagnosis_like_events_raw n_compressible_chronic_events_raw"


@query(
    "build_version_examples",
    with_views(
        "SELECT " + cols("task version split", "row_id subject_id label " + _COUNTS)
        + """ FROM (SELECT p.task, n.version, p.split, p.row_id, p.subject_id, p.label, coalesce(seq_len, 0) AS seq_len,
 coalesce(n_unique_tokens, 0) AS n_unique_tokens, len(p.codes) AS raw_seq_len, len(p.codes)-coalesce(seq_len, 0) AS n_events_removed_vs_raw,
 coalesce(n_synthetic_events, 0) AS n_synthetic_events, coalesce(c, 0) AS n_diagnosis_like_events_raw, coalesce(c, 0) AS n_compressible_chronic_events_raw
 FROM v_packed p CROSS JOIN (VALUES ('raw'),('compressed_dedup'),('compressed_first_last'),('condition_era_1'),('state_duration_3')) n(version)
 LEFT JOIN (SELECT version, row_id, count(*) AS seq_len, count(DISTINCT code) AS n_unique_tokens, count(*) FILTER (synthetic) AS n_synthetic_events
  FROM v_versions GROUP BY ALL) s ON s.version=n.version AND s.row_id=p.row_id
 LEFT JOIN (SELECT row_id, count(*) FILTER (compressible) AS c FROM v_flagged GROUP BY 1) f ON f.row_id=p.row_id)""",
        *_READ, swap=SWAP,
    ),
)
def version_examples(spark, sf_dir):
    """Example columns and audit counts, with the examples whose history is empty."""
    built = _built(spark, sf_dir).examples
    return built.select("task", "version", "split", "row_id", "subject_id", "label", *_COUNTS.split())


@query("build_version_vocab", with_views("SELECT version, code, token_id FROM b_vocab", *_READ, extra=_VOCABS, swap=SWAP))
def version_vocab(spark, sf_dir):
    return _built(spark, sf_dir).vocab


@query(
    "build_version_metadata",
    with_views(
        "SELECT " + cols("version", "n_examples n_events n_events_raw n_synthetic_events vocab_size source_vocab_size n_chronic_codes_selected")
        + """ FROM (SELECT version, (SELECT count(*) FROM v_packed) AS n_examples, count(*) AS n_events, (SELECT count(*) FROM v_flagged) AS n_events_raw,
 count(*) FILTER (synthetic) AS n_synthetic_events, (SELECT count(*) FROM b_vocab b WHERE b.version=v.version) AS vocab_size,
 (SELECT count(*) FROM v_vocab) AS source_vocab_size, 2 AS n_chronic_codes_selected FROM v_versions v GROUP BY version)""",
        *_READ, extra=_VOCABS, swap=SWAP,
    ),
)
def version_metadata(spark, sf_dir):
    return _built(spark, sf_dir).metadata
