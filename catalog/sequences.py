"""Sequence compression, code selection, vocabulary and token queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query
from catalog.sql import cols, with_views
from seqrisk.functions.arrays import log_time, normalize_arrays, tail_truncate
from seqrisk.functions.codes import is_visit_anchor
from seqrisk.operators import codes as C
from seqrisk.operators import sequence as S
from seqrisk.operators import vocab as T
from seqrisk.operators.filters import split_filter
from seqrisk.schemas import default_example_columns

EVENT_COLS = cols("code synthetic", "row_id", "idx day num")


def _compress(version: str, view: str):
    @query(
        "compress_raw" if version == "raw" else {
            "compressed_dedup": "compress_dedup",
            "compressed_first_last": "compress_first_last",
            "condition_era_1": "compress_condition_era",
            "state_duration_3": "compress_state_duration",
        }[version],
        with_views(f"SELECT {EVENT_COLS} FROM {view}", view),
    )
    def run(spark, sf_dir):
        return S.compress(V.flagged_events(spark, sf_dir), version, ["row_id"], V.ANCHOR_GAP)


for _v, _view in zip(V.VERSIONS, ["v_flagged", "v_dedup", "v_first_last", "v_condition", "v_state"]):
    _compress(_v, _view)


@query("compress_versions", with_views(f"SELECT version, {EVENT_COLS} FROM v_versions", "v_versions"))
def compress_versions(spark, sf_dir):
    return S.compress_versions(V.flagged_events(spark, sf_dir), V.VERSIONS, ["row_id"], V.ANCHOR_GAP)


@query(
    "compression_audit",
    with_views(
        "SELECT "
        + cols(
            "task version split",
            "row_id subject_id label seq_len n_unique_tokens raw_seq_len n_events_removed_vs_raw n_synthetic_events"
            " n_diagnosis_like_events_raw n_compressible_chronic_events_raw",
        )
        + " FROM v_seq",
        "v_seq",
    ),
)
def compression_audit(spark, sf_dir):
    return V.audited_examples(spark, sf_dir)


@query(
    "remaining_after_dedup",
    with_views(
        "SELECT subject_id, count(*) AS n_remaining FROM v_dedup GROUP BY subject_id", "v_dedup"
    ),
)
def remaining_after_dedup(spark, sf_dir):
    """Flagship: events of each user that remain after visit-level deduplication."""
    flagged = V.flagged_events(spark, sf_dir)
    kept = S.compress(flagged, "compressed_dedup", ["row_id", "subject_id"], V.ANCHOR_GAP)
    return kept.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_remaining"))


@query(
    "nearest_anchor",
    with_views(
        "SELECT "
        + cols("", "row_id", "e.idx day n.anchor_idx n.anchor_day").replace("AS e.idx", "AS idx")
        .replace("AS n.", "AS ")
        + " FROM v_events e LEFT JOIN (SELECT row_id AS rid, idx AS i, anchor_idx, anchor_day FROM v_near WHERE r=1) n"
        " ON e.row_id=n.rid AND e.idx=n.i WHERE e.code<>'VISIT/OP'",
        "v_near",
    ),
)
def nearest_anchor(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    anchor = is_visit_anchor(F.col("code"))
    return S.nearest_anchor(ev, anchor, ~anchor, ["row_id"], V.ANCHOR_GAP)


@query(
    "visit_bucket",
    with_views("SELECT " + cols("code visit_bucket", "row_id", "idx") + " FROM v_visit", "v_visit"),
)
def visit_bucket(spark, sf_dir):
    return S.visit_bucket(V.events(spark, sf_dir), ["row_id"], V.ANCHOR_GAP).select(
        "row_id", "idx", "code", "visit_bucket"
    )


@query(
    "split_eras",
    with_views("SELECT " + cols("code", "row_id era", "idx day") + " FROM v_eras_1", "v_eras_1"),
)
def split_eras(spark, sf_dir):
    kept = S.compress(V.flagged_events(spark, sf_dir), "compressed_dedup", ["row_id"], V.ANCHOR_GAP)
    mentions = kept.where(F.col("code").isin(V.LISTED))
    return S.split_eras(mentions, 1, ["row_id"]).select("row_id", "code", "idx", "day", "era")


# ------------------------------------------------------------------ packed rows


@query(
    "explode_events",
    with_views("SELECT " + cols("code", "row_id", "idx day num") + " FROM v_packed_events", "v_packed_events"),
)
def explode_events(spark, sf_dir):
    return S.explode_events(V.packed(spark, sf_dir)).drop("synthetic")


@query(
    "normalize_arrays",
    with_views("SELECT " + cols("code", "row_id pos", "day delta num") + " FROM (SELECT *, idx AS pos FROM v_packed_events)", "v_packed_events"),
)
def normalize(spark, sf_dir):
    aligned = normalize_arrays(
        F.col("codes"), F.col("days_before_prediction"), F.col("delta_days"), F.col("numeric_values")
    )
    return V.packed(spark, sf_dir).select("row_id", F.posexplode(aligned).alias("pos", "e")).select(
        "row_id", "pos", "e.code", "e.day", "e.delta", "e.num"
    )


@query(
    "collect_sequence",
    with_views(
        "SELECT row_id, count(*) AS n, string_agg(code, ',' ORDER BY idx) AS codes,"
        " round(sum(day*(idx+1)),6) AS day_by_position, round(sum(num*(idx+1)),6) AS num_by_position FROM v_events GROUP BY row_id",
        "v_events",
    ),
)
def collect_sequence(spark, sf_dir):
    seq = S.collect_sequence(V.events(spark, sf_dir))

    def weighted(name):
        products = F.transform(F.col(name), lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1 + F.col("first_pos")))
        return F.sum(F.aggregate(products, F.lit(0.0), lambda a, v: a + v))

    return seq.groupBy("row_id").agg(
        F.sum(F.size("codes")).alias("n"),
        F.concat_ws(",", F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("segment", "codes"))), lambda s: s["codes"]))).alias("codes"),
        weighted("days_before_prediction").alias("day_by_position"),
        weighted("numeric_values").alias("num_by_position"),
    )


@query(
    "delta_days",
    with_views(
        "SELECT " + cols("code", "row_id", "idx day delta")
        + " FROM (SELECT *, coalesce(greatest(lag(day) OVER (PARTITION BY row_id ORDER BY idx)-day, 0), 0) AS delta FROM v_dedup)",
        "v_dedup",
    ),
)
def delta_days(spark, sf_dir):
    kept = S.compress(V.flagged_events(spark, sf_dir), "compressed_dedup", ["row_id"], V.ANCHOR_GAP)
    return S.delta_days(kept).select("row_id", "idx", "code", "day", "delta")


@query(
    "default_columns",
    with_views(
        "SELECT " + cols("task", "row_id pos", "day delta num")
        + " FROM (SELECT row_id, task, i AS pos, d[i+1] AS day, CASE WHEN i=0 THEN 0 ELSE greatest(d[i]-d[i+1], 0) END AS delta,"
        " NULL::DOUBLE AS num FROM (SELECT *, unnest(range(0, len(d))) AS i FROM (SELECT row_id, task,"
        " list_transform(days_before_prediction, lambda x: greatest(x, 0)) AS d FROM v_packed)))",
        "v_packed",
    ),
)
def default_columns(spark, sf_dir):
    bare = V.packed(spark, sf_dir).drop("task", "numeric_values", "delta_days")
    full = default_example_columns(bare, "vectors")
    return full.select("row_id", "task", F.posexplode("delta_days").alias("pos", "delta"), "days_before_prediction", "numeric_values").select(
        "row_id", "task", "pos", F.get("days_before_prediction", F.col("pos")).alias("day"), "delta",
        F.get("numeric_values", F.col("pos")).alias("num"),
    )


_TAIL = """SELECT {c} FROM (SELECT row_id, pos, token_id, day, delta, num FROM (
 SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY idx)-1 AS pos, {tok} AS token_id, day, delta, num FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY idx DESC) AS back FROM v_packed_events) WHERE back<=20)
 UNION ALL SELECT row_id, 0, 1, 0, 0, NULL FROM v_packed WHERE len(codes)=0)"""


@query(
    "tail_truncate",
    with_views(
        _TAIL.format(c=cols("", "row_id pos token_id", "day delta num"), tok="length(code)"), "v_packed_events"
    ),
)
def tail_trunc(spark, sf_dir):
    rows = V.packed(spark, sf_dir)
    aligned = normalize_arrays(F.col("codes"), F.col("days_before_prediction"), F.col("delta_days"), F.col("numeric_values"))
    rows = rows.select("row_id", aligned.alias("e"))

    def field(name):
        return F.transform("e", lambda e: e[name])

    cut = tail_truncate(F.transform("e", lambda e: F.length(e["code"])), field("day"), field("delta"), field("num"), 20)
    return rows.select("row_id", F.posexplode(cut).alias("pos", "t")).select("row_id", "pos", "t.token_id", "t.day", "t.delta", "t.num")


@query(
    "log_time_features",
    with_views(
        "SELECT " + cols("", "row_id idx", "log_day log_delta")
        + " FROM (SELECT row_id, idx, ln(1+day) AS log_day, ln(1+delta) AS log_delta FROM v_packed_events)",
        "v_packed_events",
    ),
)
def log_time_features(spark, sf_dir):
    rows = V.packed(spark, sf_dir)
    aligned = normalize_arrays(F.col("codes"), F.col("days_before_prediction"), F.col("delta_days"), F.col("numeric_values"))
    e = rows.select("row_id", aligned.alias("e"))
    logs = F.arrays_zip(
        log_time(F.transform("e", lambda x: x["day"])).alias("d"), log_time(F.transform("e", lambda x: x["delta"])).alias("g")
    )
    return e.select("row_id", F.posexplode(logs).alias("idx", "z")).select(
        "row_id", "idx", F.col("z.d").alias("log_day"), F.col("z.g").alias("log_delta")
    )


# ------------------------------------------------------------------ codes and vocabulary

_UPPER = "upper(trim(code))"
_EXCLUDE = "LOINC|RXNORM|CPT4|VISIT|CARE_SITE|DRUG|MEDICATION|PROCEDURE|DEVICE|LAB|MEASUREMENT|OBSERVATION_PERIOD|PERSON/|STATIC|GENDER|RACE|ETHNICITY"
_NAME_RULE = f"(NOT regexp_matches({_UPPER},'{_EXCLUDE}') AND regexp_matches({_UPPER},'SNOMED|CONDITION|DIAG|DIAGNOS|ICD|DX/'))"


@query(
    "is_diagnosis_like",
    with_views(
        f"SELECT code, by_name, by_list, count(*) AS n FROM (SELECT code, {_NAME_RULE} AS by_name,"
        " upper(trim(code)) IN ('SNOMED/ERROR','ICD/PURCHASE','ICD/NEVER_SEEN') AS by_list FROM v_state) GROUP BY ALL",
        "v_state",
    ),
)
def is_diagnosis_like(spark, sf_dir):
    ev = S.compress(V.flagged_events(spark, sf_dir), "state_duration_3", ["row_id"], V.ANCHOR_GAP)
    named = C.diagnosis_flag(ev).withColumnRenamed("is_diagnosis", "by_name")
    listed = C.diagnosis_flag(named, V.code_list(spark)).withColumnRenamed("is_diagnosis", "by_list")
    return listed.groupBy("code", "by_name", "by_list").agg(F.count(F.lit(1)).alias("n"))


@query(
    "is_visit_anchor",
    with_views(
        "SELECT code, regexp_matches(upper(trim(code)),'^VISIT($|[/_:])') AS anchor, count(*) AS n FROM"
        " (SELECT CASE WHEN idx%5=0 THEN ' visit:x' WHEN idx%5=1 THEN 'VISITOR' ELSE code END AS code FROM v_events) GROUP BY ALL",
        "v_events",
    ),
)
def visit_anchor(spark, sf_dir):
    varied = F.when(F.col("idx") % 5 == 0, " visit:x").when(F.col("idx") % 5 == 1, "VISITOR").otherwise(F.col("code"))
    ev = V.events(spark, sf_dir).select(varied.alias("code"))
    return ev.groupBy("code", is_visit_anchor(F.col("code")).alias("anchor")).agg(F.count(F.lit(1)).alias("n"))


_PERSISTENT = """SELECT code, count(*) AS n_subjects, count(*) FILTER (n>=2) AS n_repeated_subjects, avg(n) AS mean_occurrences_per_subject,
 median(n) AS median_occurrences_per_subject, median(span) AS median_span_days, quantile_cont(span,0.75) AS p75_span_days FROM (
 SELECT code, subject_id, count(*) AS n, greatest(max(day)-min(day),0) AS span FROM v_events WHERE split='train' AND """ + _NAME_RULE + """ GROUP BY ALL) GROUP BY code"""
_KEEP = "n_subjects>=5 AND mean_occurrences_per_subject>=2 AND median_span_days>=1"
_STAT_COLS = cols(
    "code selected_for_compression selection_source",
    "n_subjects n_repeated_subjects",
    "mean_occurrences_per_subject median_occurrences_per_subject median_span_days p75_span_days",
)
_STATS = f"SELECT {_STAT_COLS} FROM (SELECT *, {_KEEP} AS selected_for_compression, 'inferred_from_cached_train_examples' AS selection_source FROM ({_PERSISTENT}))"


def _persistent(spark, sf_dir):
    train = split_filter(V.events(spark, sf_dir), "train")
    return C.infer_persistent_codes(C.diagnosis_flag(train), 5, 2.0, 1.0)


@query("infer_persistent_codes", with_views(_STATS, "v_events"))
def infer_persistent_codes(spark, sf_dir):
    return _persistent(spark, sf_dir)


@query("sort_code_stats", with_views(_STATS + " ORDER BY selected_for_compression DESC, n_subjects DESC, mean_occurrences_per_subject DESC, median_span_days DESC, code", "v_events"))
def sorted_stats(spark, sf_dir):
    return C.sort_code_stats(_persistent(spark, sf_dir))


@query(
    "choose_codes",
    with_views(
        f"SELECT 'listed' AS mode, code FROM (SELECT DISTINCT code FROM v_events WHERE code IN ('SNOMED/error','ICD/purchase','ICD/never_seen'))"
        f" UNION ALL SELECT 'inferred', code FROM ({_PERSISTENT}) WHERE {_KEEP}",
        "v_events",
    ),
)
def choose_codes(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    listed = C.choose_codes(ev, V.code_list(spark)).select(F.lit("listed").alias("mode"), "code")
    inferred = C.choose_codes(ev, None, min_subjects=5, min_mean_occurrences=2.0, min_span_days=1.0)
    return listed.unionByName(inferred.select(F.lit("inferred").alias("mode"), "code"))


@query(
    "present_codes",
    with_views(
        "SELECT c AS code, 'listed' AS selection_source, c IN (SELECT code FROM v_events) AS present_in_cached_examples,"
        " c IN (SELECT code FROM v_events) AS selected_for_compression FROM (VALUES ('SNOMED/error'),('ICD/purchase'),('ICD/never_seen')) t(c)",
        "v_events",
    ),
)
def present_codes(spark, sf_dir):
    return C.present_codes(V.code_list(spark), V.events(spark, sf_dir))


def _strong_possible(spark, sf_dir):
    used = V.table(spark, sf_dir, "events").select("event_type").distinct()
    strong = used.where(F.col("event_type").isin("error", "purchase")).select(F.col("event_type").alias("code"))
    possible = used.where(F.col("event_type").isin("purchase", "click")).select(F.col("event_type").alias("code"))
    return strong, possible


@query(
    "whitelist_codes",
    "SELECT 'strong_only' AS mode, event_type AS code FROM (SELECT DISTINCT event_type FROM events) WHERE event_type IN ('error','purchase')"
    " UNION ALL SELECT 'strong_plus_possible', event_type FROM (SELECT DISTINCT event_type FROM events) WHERE event_type IN ('error','purchase','click')",
)
def whitelist_codes(spark, sf_dir):
    strong, possible = _strong_possible(spark, sf_dir)
    only = C.whitelist_codes(strong, possible, "strong_only").select(F.lit("strong_only").alias("mode"), "code")
    both = C.whitelist_codes(strong, possible, "strong_plus_possible")
    return only.unionByName(both.select(F.lit("strong_plus_possible").alias("mode"), "code"))


@query(
    "code_set_ops",
    "SELECT 'union' AS op, event_type AS code FROM (SELECT DISTINCT event_type FROM events) WHERE event_type IN ('error','purchase','click')"
    " UNION ALL SELECT 'intersection', event_type FROM (SELECT DISTINCT event_type FROM events) WHERE event_type='purchase'",
)
def code_set_ops(spark, sf_dir):
    strong, possible = _strong_possible(spark, sf_dir)
    union = C.code_union(strong, possible).select(F.lit("union").alias("op"), "code")
    return union.unionByName(C.code_intersection(strong, possible).select(F.lit("intersection").alias("op"), "code"))


_VOCAB = """SELECT code, token_id::BIGINT AS token_id FROM v_vocab UNION ALL
 SELECT code, ((SELECT max(token_id) FROM v_vocab)+row_number() OVER (ORDER BY n DESC, code))::BIGINT FROM (
 SELECT v.code, count(*) AS n FROM v_versions v JOIN v_labels l USING (row_id) WHERE l.split='train' AND v.code NOT IN (SELECT code FROM v_vocab) GROUP BY 1)"""


@query("build_vocab", with_views(_VOCAB, "v_vocab", "v_versions", "v_labels"))
def build_vocab(spark, sf_dir):
    train = split_filter(V.flagged_events(spark, sf_dir), "train")
    every = S.compress_versions(train, V.VERSIONS, ["row_id"], V.ANCHOR_GAP)
    return T.build_vocab(every, V.vocab(spark, sf_dir))


@query(
    "encode_tokens",
    with_views(
        "SELECT row_id, CAST(idx AS BIGINT) AS idx, coalesce(token_id, 1)::BIGINT AS token_id FROM v_events LEFT JOIN v_vocab USING (code)",
        "v_events", "v_vocab",
    ),
)
def encode_tokens(spark, sf_dir):
    out = T.encode_tokens(V.events(spark, sf_dir), V.vocab(spark, sf_dir))
    return out.select("row_id", F.col("idx").cast("long").alias("idx"), "token_id")


@query(
    "decode_tokens",
    with_views(
        "SELECT row_id, CAST(idx AS BIGINT) AS idx, coalesce(v.code, '<UNK>') AS code FROM"
        " (SELECT row_id, idx, (event_id+idx)%9 AS t FROM (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY ts, event_id)-1 AS idx, event_id*0 AS event_id FROM v_raw_events)) e"
        " LEFT JOIN v_vocab v ON v.token_id=e.t",
        "v_raw_events", "v_vocab",
    ),
)
def decode_tokens(spark, sf_dir):
    tokens = V.events(spark, sf_dir).select("row_id", F.col("idx").cast("long").alias("idx"), (F.col("idx") % 9).cast("int").alias("token_id"))
    return T.decode_tokens(tokens, V.vocab(spark, sf_dir)).drop("token_id")


_STAT_VIEW = """t_tok AS (SELECT e.row_id, e.idx, e.split, coalesce(v.token_id, 1) AS token_id,
 CASE WHEN e.code='RXNORM/signup' AND e.idx>2 THEN NULL ELSE e.num END AS num FROM v_events e LEFT JOIN v_vocab v USING (code)),
t_stats AS (SELECT v.token_id, coalesce(n,0) AS c, CASE WHEN n>=3 THEN m ELSE 0 END AS mean, CASE WHEN n>=3 THEN sqrt(greatest(var,1e-6::DOUBLE)) ELSE 1 END AS std
 FROM v_vocab v LEFT JOIN (SELECT token_id, count(num) AS n, avg(num) AS m, var_pop(num) AS var FROM t_tok WHERE split='train' GROUP BY 1) s USING (token_id))"""


def _tokens(spark, sf_dir):
    sparse = F.when(~((F.col("code") == "RXNORM/signup") & (F.col("idx") > 2)), F.col("num"))
    ev = V.events(spark, sf_dir).withColumn("num", sparse)
    return T.encode_tokens(ev, V.vocab(spark, sf_dir))


@query(
    "token_numeric_stats",
    with_views(
        "SELECT " + cols("has_enough_numeric_stats", "token_id numeric_count_train", "numeric_mean_train numeric_std_train")
        + " FROM (SELECT token_id, c AS numeric_count_train, mean AS numeric_mean_train, std AS numeric_std_train, c>=3 AS has_enough_numeric_stats FROM t_stats)",
        "v_events", "v_vocab", extra=_STAT_VIEW,
    ),
)
def token_numeric_stats(spark, sf_dir):
    train = split_filter(_tokens(spark, sf_dir), "train")
    return T.token_numeric_stats(train, V.vocab(spark, sf_dir))


@query(
    "numeric_zscore",
    with_views(
        "SELECT " + cols("", "row_id idx", "z present")
        + " FROM (SELECT row_id, idx, CASE WHEN num IS NULL THEN 0 ELSE least(greatest((num-mean)/greatest(std,1e-6::DOUBLE),-10),10) END AS z,"
        " (num IS NOT NULL)::INT AS present FROM t_tok JOIN t_stats USING (token_id))",
        "v_events", "v_vocab", extra=_STAT_VIEW,
    ),
)
def numeric_zscore(spark, sf_dir):
    ev = _tokens(spark, sf_dir)
    stats = T.token_numeric_stats(split_filter(ev, "train"), V.vocab(spark, sf_dir))
    out = T.numeric_zscore(ev, stats)
    return out.select("row_id", F.col("idx").cast("long").alias("idx"), "z", "present")
