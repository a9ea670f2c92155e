"""Reading, writing and feature tables. Each scan query writes derived rows and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query, scratch
from catalog.sql import cols, with_views
from seqrisk.operators import features as W
from seqrisk.operators import joins as J
from seqrisk.operators.summary import dataset_summary
from seqrisk.schemas import PREDICTION_KEY, default_cost_columns
from seqrisk.sources import readers as R
from seqrisk.sources import writers as Q


def _flat(df, *keep):
    """Every element of the packed arrays; an example without events keeps one row."""
    arrays = ["codes", "days_before_prediction", "delta_days", "numeric_values"]
    rows = df.select(*keep, F.posexplode_outer(F.arrays_zip(*arrays)).alias("pos", "e"))
    return rows.select(
        *keep, "pos", F.col("e.codes").alias("code"), F.col("e.days_before_prediction").alias("day"),
        F.col("e.delta_days").alias("delta"), F.col("e.numeric_values").alias("num"),
    )


_LONGEST = "greatest(len(codes), len(days_before_prediction), len(delta_days), len(numeric_values))"
_PACKED_SQL = (
    "SELECT " + cols("task version split code", "row_id subject_id label pos", "day delta num")
    + " FROM (SELECT *, codes[pos+1] AS code, days_before_prediction[pos+1] AS day, delta_days[pos+1] AS delta, numeric_values[pos+1] AS num"
    f" FROM (SELECT *, unnest(CASE WHEN {_LONGEST}=0 THEN [NULL::BIGINT] ELSE range(0, {_LONGEST}) END) AS pos FROM ({{src}})))"
)


@query("scan_examples", with_views(_PACKED_SQL.format(src="SELECT * FROM v_packed"), "v_packed"))
def scan_examples(spark, sf_dir):
    root = scratch(spark, "examples")
    packed = V.packed(spark, sf_dir)
    Q.write_examples(packed.unionByName(packed.withColumn("version", F.lit("other"))), root)
    back = R.read_examples(spark, root, "vectors", "raw")
    return _flat(back, "task", "version", "split", "row_id", "subject_id", "label")


@query(
    "sink_examples",
    with_views(_PACKED_SQL.format(src="SELECT * FROM v_packed UNION ALL SELECT * REPLACE ('other' AS version) FROM v_packed WHERE row_id%2=0"), "v_packed"),
)
def sink_examples(spark, sf_dir):
    """Two writes to one dataset: the second adds a version and leaves the first in place."""
    root = scratch(spark, "sink-examples")
    packed = V.packed(spark, sf_dir)
    Q.write_examples(packed, root)
    Q.write_examples(packed.where(F.col("row_id") % 2 == 0).withColumn("version", F.lit("other")), root)
    return _flat(R.read_examples(spark, root), "task", "version", "split", "row_id", "subject_id", "label")


@query("scan_vocab", with_views("SELECT code, token_id::BIGINT AS token_id, d AS direction FROM v_vocab, (VALUES ('code_to_id'), ('id_to_code')) t(d)", "v_vocab"))
def scan_vocab(spark, sf_dir):
    vocab = V.vocab(spark, sf_dir)
    forward, backward = scratch(spark, "vocab"), scratch(spark, "vocab-ids")
    Q.vocab_document(vocab).write.text(forward)
    swapped = F.transform(F.sort_array(F.collect_list(F.struct("token_id", "code"))), lambda e: F.struct(e["token_id"].cast("string").alias("key"), e["code"].alias("value")))
    vocab.agg(F.to_json(F.map_from_entries(swapped)).alias("value")).write.text(backward)
    a = R.read_vocab(spark, forward).withColumn("direction", F.lit("code_to_id"))
    return a.unionByName(R.read_vocab(spark, backward).withColumn("direction", F.lit("id_to_code")))


_FEATS = "n_visit mean_visit n_error mean_error n_purchase mean_purchase n_click mean_click empty constant"


@query("scan_tabular", with_views("SELECT " + cols("task split", "row_id subject_id label", _FEATS) + ", 10 AS n_features FROM v_features", "v_features").replace("10 AS n_features", "10::BIGINT AS n_features"))
def scan_tabular(spark, sf_dir):
    path = scratch(spark, "features.parquet")
    Q.write_table(V.tabular_features(spark, sf_dir), path)
    df, columns = R.read_tabular_features(spark, path)
    return df.withColumn("n_features", F.lit(len(columns)))


@query("scan_features", with_views("SELECT " + cols("task split", "row_id subject_id label", _FEATS) + " FROM v_features WHERE task='late'", "v_features"))
def scan_features(spark, sf_dir):
    path = scratch(spark, "features.parquet")
    Q.write_table(V.tabular_features(spark, sf_dir), path)
    return R.reuse_features(spark, path, ["late"])


_FUSED = cols("task variant split", "seed row_id subject_id y_true", "risk")


@query("scan_predictions", with_views(f"SELECT {_FUSED} FROM v_fusion", "v_fusion"))
def scan_predictions(spark, sf_dir):
    """Gzipped CSV with a leftover index column and rows of another split."""
    path = scratch(spark, "predictions.csv.gz")
    pred = V.fusion_predictions(spark, sf_dir)
    extra = pred.withColumn("split", F.lit("tuning"))
    Q.write_table(pred.unionByName(extra).withColumn("Unnamed: 0", F.lit(1)), path, "csv.gz")
    return R.read_predictions(spark, path)


_MULTI = cols("task family source version model calibration", "seed row_id subject_id y_true", "risk")


@query(
    "scan_predictions_multi",
    with_views(
        f"SELECT {_MULTI} FROM (SELECT * REPLACE ('tabular' AS family, 'tabular' AS source, 'tabular_all_features' AS version) FROM v_predictions WHERE model='trees'"
        " UNION ALL SELECT * FROM v_predictions WHERE model='rnn_numeric')",
        "v_predictions",
    ),
)
def scan_predictions_multi(spark, sf_dir):
    """Two files, one of them without family, source and version."""
    a, b = scratch(spark, "trees.csv"), scratch(spark, "numeric.csv")
    pred = V.predictions(spark, sf_dir)
    Q.write_table(pred.where(F.col("model") == "trees").drop("family", "source", "version"), a, "csv")
    Q.write_table(pred.where(F.col("model") == "rnn_numeric"), b, "csv")
    return R.read_predictions_multi(spark, [a, b], "tabular").select(
        "task", "family", "source", "version", "model", "calibration", "seed", "row_id", "subject_id", "y_true", "risk"
    )


@query(
    "scan_with_source_file",
    with_views(
        "SELECT CASE WHEN row_id%4=0 THEN 'second' ELSE 'first' END AS file, task, model, version, " + cols("", "seed row_id subject_id y_true", "risk")
        + " FROM (SELECT * REPLACE (risk+(row_id%4=0)::INT*0.5::DOUBLE AS risk) FROM v_predictions WHERE model='rnn')",
        "v_predictions",
    ),
)
def scan_with_source_file(spark, sf_dir):
    """A second file repeats some rows with other scores; the row loaded last wins."""
    a, b = scratch(spark, "first.csv"), scratch(spark, "second.csv")
    pred = V.predictions(spark, sf_dir).where(F.col("model") == "rnn")
    Q.write_table(pred, a, "csv")
    Q.write_table(pred.where(F.col("row_id") % 4 == 0).withColumn("risk", F.col("risk") + 0.5), b, "csv")
    loaded = R.read_predictions_provenance(spark, [a, b], "raw")
    file = F.regexp_extract("source_file", r"(first|second)\.csv", 1)
    # Only what is returned goes through the sort, the name of the file instead of its path.
    named = loaded.select(*PREDICTION_KEY, "y_true", "risk", file.alias("file"), "load_order")
    last = J.dedup(named, PREDICTION_KEY, ["load_order"])
    return last.select("file", "task", "model", "version", "seed", "row_id", "subject_id", "y_true", "risk")


@query(
    "scan_code_whitelist",
    "SELECT upper(event_type) AS code, 'strong' AS selection_source FROM (SELECT DISTINCT event_type FROM events) WHERE event_type<>'view'",
)
def scan_code_whitelist(spark, sf_dir):
    path = scratch(spark, "codes.csv")
    kinds = V.table(spark, sf_dir, "events").select("event_type").distinct()
    padded = F.when(F.col("event_type") == "view", "   ").otherwise(F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")))
    Q.write_table(kinds.select(F.lit("x").alias("note"), padded.alias("concept_code")), path, "csv")
    return R.read_code_whitelist(spark, path, "strong")


_AUDIT = cols("task split", "row_id subject_id label", "repeat_removed_first_last raw_sequence_length_non_static n_diag_codes_persistent_365d")


@query("scan_audit", with_views(f"SELECT {_AUDIT} FROM v_audit", "v_audit"))
def scan_audit(spark, sf_dir):
    audit = V.history_audit(spark, sf_dir)
    paths = {t: scratch(spark, f"audit-{t}.csv") for t in V.TASKS}
    for task, path in paths.items():
        Q.write_table(audit.where(F.col("task") == task).drop("task").withColumn("unused", F.lit(0)), path, "csv")
    return R.read_audit_history(spark, paths)


@query(
    "sink_tables",
    with_views(f"SELECT k AS kind, {_FUSED} FROM v_fusion, (VALUES ('csv'),('csv.gz'),('parquet')) t(k)", "v_fusion"),
)
def sink_tables(spark, sf_dir):
    pred = V.fusion_predictions(spark, sf_dir)
    out = None
    for kind in Q.FORMATS:
        path = scratch(spark, f"table.{kind}")
        Q.write_table(pred, path, kind)
        back = R.read_predictions(spark, path).withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


@query(
    "sink_metadata",
    with_views(
        "SELECT 'vocab' AS what, code AS name, token_id::BIGINT AS value FROM v_vocab UNION ALL SELECT 'metadata', 'n_examples', count(*) FROM v_packed"
        " UNION ALL SELECT 'metadata', 'n_subjects', count(DISTINCT subject_id) FROM v_packed",
        "v_vocab", "v_packed",
    ),
)
def sink_metadata(spark, sf_dir):
    words, about = scratch(spark, "vocab.json"), scratch(spark, "metadata.json")
    Q.write_vocab(V.vocab(spark, sf_dir), words)
    counted = V.packed(spark, sf_dir).withColumn("seq_len", F.size("codes"))
    summary = dataset_summary(default_cost_columns(counted))
    Q.write_metadata(summary, about)
    vocab = spark.read.schema("code string, token_id int").json(words).select(F.lit("vocab").alias("what"), F.col("code").alias("name"), F.col("token_id").cast("long").alias("value"))
    meta = spark.read.schema("n_examples long, n_subjects long").json(about)
    return vocab.unionByName(meta.unpivot([], ["n_examples", "n_subjects"], "name", "value").withColumn("what", F.lit("metadata")))


# ------------------------------------------------------------------ feature tables

_TABS = [f"tab__{i:04d}" for i in range(10)]


@query(
    "prefix_features",
    with_views(
        "SELECT " + cols("task split", "seed row_id subject_id y_true", " ".join(_TABS)) + " FROM (SELECT task, split, 42 AS seed, row_id, subject_id, label AS y_true, "
        + ", ".join(f"{c} AS {t}" for c, t in zip(_FEATS.split(), _TABS)) + " FROM v_features WHERE split IN ('tuning','held_out'))",
        "v_features",
    ),
)
def prefix_features(spark, sf_dir):
    return W.prefix_features(V.tabular_features(spark, sf_dir), 42)


_EMB = " ".join([f"seq_emb__{i:04d}" for i in range(V.WIDTH)] + [f"numseq_emb__{i:04d}" for i in range(V.WIDTH)])


@query(
    "unpack_embedding",
    with_views(
        "SELECT " + cols("task split", "seed row_id", _EMB) + " FROM (SELECT task, split, seed, row_id, "
        + ", ".join([f"seq_emb[{i + 1}] AS seq_emb__{i:04d}" for i in range(V.WIDTH)] + [f"numseq_emb[{i + 1}] AS numseq_emb__{i:04d}" for i in range(V.WIDTH)]) + " FROM v_embedding)",
        "v_embedding",
    ),
)
def unpack_embedding(spark, sf_dir):
    return _unpacked(V.embedding_features(spark, sf_dir)).drop("subject_id", "y_true", *[f"tab__{i:04d}" for i in range(3)])


def _unpacked(df):
    return W.unpack_embedding(W.unpack_embedding(df, "seq_emb", V.WIDTH, "seq_emb__"), "numseq_emb", V.WIDTH, "numseq_emb__")


@query(
    "feature_groups",
    with_views(
        "SELECT variant, n_features, count(*) AS n_rows FROM v_embedding, (VALUES ('tabular_features_only', 3::BIGINT), ('sequence_embedding_only', 64), ('numeric_sequence_embedding_only', 64),"
        " ('tabular_plus_sequence_embedding', 67), ('tabular_plus_numeric_sequence_embedding', 67), ('tabular_plus_sequence_numeric_embeddings', 131)) t(variant, n_features) GROUP BY ALL",
        "v_embedding",
    ),
)
def feature_groups(spark, sf_dir):
    df = _unpacked(V.embedding_features(spark, sf_dir))
    sizes = {v: len(W.variant_columns(df.columns, g)) for v, g in W.FEATURE_VARIANTS.items()}
    listed = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(n).alias("n_features")) for v, n in sizes.items()])
    return df.select(F.inline(listed)).groupBy("variant", "n_features").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "usable_columns",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, count({c}) AS n_finite, round(stddev_pop({c}), 6) AS std, coalesce(count({c})>0 AND stddev_pop({c})>1e-12, FALSE) AS usable FROM v_features WHERE split='train'"
            for c in _FEATS.split()
        ),
        "v_features",
    ),
)
def usable_columns(spark, sf_dir):
    train = V.tabular_features(spark, sf_dir).where(F.col("split") == "train")
    return W.column_profile(train, W.feature_columns(train))


@query(
    "ensemble_features",
    with_views(
        "SELECT task, split, row_id, subject_id, " + cols("", "seed y_true", "tab__0000 tab__0001 tab__0002 " + _EMB) + " FROM (SELECT task, split, row_id, subject_id, y_true, -1 AS seed,"
        " arg_min(tab__0000, seed) AS tab__0000, arg_min(tab__0001, seed) AS tab__0001, arg_min(tab__0002, seed) AS tab__0002, "
        + ", ".join([f"avg(seq_emb[{i + 1}]) AS seq_emb__{i:04d}" for i in range(V.WIDTH)] + [f"avg(numseq_emb[{i + 1}]) AS numseq_emb__{i:04d}" for i in range(V.WIDTH)])
        + " FROM v_embedding GROUP BY task, split, row_id, subject_id, y_true)",
        "v_embedding",
    ),
)
def ensemble_features(spark, sf_dir):
    tabs = [f"tab__{i:04d}" for i in range(3)]
    return _unpacked(J.ensemble_features(V.embedding_features(spark, sf_dir), tabs, {"seq_emb": V.WIDTH, "numseq_emb": V.WIDTH}))


@query(
    "feature_manifest",
    with_views(
        "SELECT task, seed::BIGINT AS seed, count(*) AS n_rows, 3::BIGINT AS n_tabular_features, 64::BIGINT AS n_sequence_embedding_features, 64::BIGINT AS n_numeric_sequence_embedding_features FROM v_embedding GROUP BY ALL",
        "v_embedding",
    ),
)
def feature_manifest(spark, sf_dir):
    return W.feature_manifest(_unpacked(V.embedding_features(spark, sf_dir)))


@query(
    "balanced_weights",
    with_views(
        "SELECT task, greatest(neg,1)::BIGINT AS n_neg, greatest(pos,1)::BIGINT AS n_pos, round((neg+pos)/2.0/neg, 6) AS weight_neg, round((neg+pos)/2.0/pos, 6) AS weight_pos FROM"
        " (SELECT task, count(*) FILTER (y_true=0) AS neg, count(*) FILTER (y_true=1) AS pos FROM v_doc_predictions GROUP BY task)",
        "v_doc_predictions",
    ),
)
def balanced_weights(spark, sf_dir):
    return W.balanced_weights(V.document_predictions(spark, sf_dir), ["task"])
