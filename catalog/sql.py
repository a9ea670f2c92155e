"""SQL twins of the input views, put together as common table expressions."""

from __future__ import annotations

CODE = """CASE event_type WHEN 'view' THEN 'VISIT/OP' WHEN 'error' THEN 'SNOMED/error'
 WHEN 'purchase' THEN 'ICD/purchase' WHEN 'click' THEN 'LOINC/click' WHEN 'signup' THEN 'RXNORM/signup' END"""

_MODELS = """(VALUES ('tabular','tabular','tabular_all_features','trees',40),
 ('sequence','sequence','raw','rnn',10), ('sequence','sequence','compressed_dedup','rnn',20),
 ('numeric_sequence','numeric_sequence','compressed_dedup','rnn_numeric',25)) m(family, source, version, model, w)"""

_TASK = "CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'urgent' ELSE 'routine' END"

# name -> (views it reads, body)
VIEWS: dict[str, tuple[list[str], str]] = {
    "v_raw_events": (
        [],
        f"""SELECT user_id*10+k AS row_id, user_id AS subject_id, CASE k WHEN 1 THEN 'early' ELSE 'late' END AS task,
 CASE WHEN user_id%10<=5 THEN 'train' WHEN user_id%10<=7 THEN 'tuning' ELSE 'held_out' END AS split,
 ts, event_id, {CODE} AS code, (epoch_us(t)-epoch_us(ts))/86400000000::DOUBLE AS day, value AS num
 FROM events, (VALUES (1, TIMESTAMP '2024-01-16'), (2, TIMESTAMP '2024-01-31')) p(k, t) WHERE ts < t""",
    ),
    "v_events": (
        ["v_raw_events"],
        """SELECT row_id, subject_id, task, split,
 (row_number() OVER (PARTITION BY row_id ORDER BY ts, event_id)-1)::DOUBLE AS idx, code, day, num, FALSE AS synthetic
 FROM v_raw_events""",
    ),
    "v_flagged": (
        ["v_events"],
        "SELECT *, code IN ('SNOMED/error','ICD/purchase') AS compressible FROM v_events",
    ),
    "v_labels": (
        ["v_events"],
        """SELECT row_id, subject_id, task, split,
 (arg_max(code, idx) IN ('SNOMED/error','ICD/purchase'))::INT AS label FROM v_events GROUP BY ALL""",
    ),
    # Every event with every anchor of its example, closest first.
    "v_near": (
        ["v_events"],
        """SELECT e.row_id, e.idx, a.idx AS anchor_idx, a.day AS anchor_day,
 row_number() OVER (PARTITION BY e.row_id, e.idx ORDER BY abs(e.day-a.day), abs(e.idx-a.idx), a.idx) AS r
 FROM v_events e JOIN v_events a ON e.row_id=a.row_id AND a.code='VISIT/OP' AND abs(e.day-a.day)<=0.25""",
    ),
    "v_visit": (
        ["v_flagged", "v_near"],
        """SELECT f.*, n.anchor_idx, n.anchor_day,
 CASE WHEN f.code='VISIT/OP' THEN 'visit::'||f.idx::BIGINT WHEN n.anchor_idx IS NOT NULL THEN 'visit::'||n.anchor_idx::BIGINT
 ELSE 'day::'||round_even(f.day,0)::BIGINT END AS visit_bucket
 FROM v_flagged f LEFT JOIN v_near n ON f.row_id=n.row_id AND f.idx=n.idx AND n.r=1""",
    ),
    "v_dedup": (
        ["v_visit"],
        """SELECT * FROM v_visit QUALIFY NOT compressible
 OR row_number() OVER (PARTITION BY row_id, code, visit_bucket, compressible ORDER BY idx)=1""",
    ),
    "v_first_last": (
        ["v_dedup"],
        """WITH g AS (SELECT row_id, code, min(idx) i1, max(idx) i2, count(*) n, arg_min(day, idx) d1, arg_max(day, idx) d2
 FROM v_dedup WHERE compressible GROUP BY ALL)
 SELECT row_id, idx, code, day, num, FALSE AS synthetic FROM v_dedup WHERE NOT compressible
 UNION ALL SELECT d.row_id, d.idx, d.code, d.day, d.num, FALSE FROM v_dedup d JOIN g USING (row_id, code) WHERE compressible AND n=1
 UNION ALL SELECT row_id, i1, 'DX_FIRST/'||code, d1, 0, TRUE FROM g WHERE n>1
 UNION ALL SELECT row_id, i2, 'DX_LAST/'||code, d2, greatest(d1-d2, 0), TRUE FROM g WHERE n>1""",
    ),
    "v_condition": (["v_eras_1"], ""),
    "v_state": (["v_eras_3"], ""),
    "v_vocab": (
        [],
        f"""SELECT code, (1+row_number() OVER (ORDER BY code))::INT AS token_id FROM (SELECT DISTINCT {CODE} AS code FROM events
 WHERE event_type<>'signup') WHERE code IS NOT NULL UNION ALL VALUES ('<PAD>', 0), ('<UNK>', 1)""",
    ),
    "v_packed": (
        [],
        """SELECT 'vectors' AS task, 'raw' AS version, vec_id AS row_id, vec_id%50 AS subject_id, (label<3)::INT AS label,
 CASE WHEN vec_id%50%10<=5 THEN 'train' WHEN vec_id%50%10<=7 THEN 'tuning' ELSE 'held_out' END AS split,
 list_transform(embedding[1:(vec_id%7*9)], lambda x: CASE WHEN x < -0.1::DOUBLE THEN 'ICD/low' WHEN x < 0 THEN 'SNOMED/minus'
  WHEN x < 0.1::DOUBLE THEN 'VISIT/OP' ELSE 'LOINC/high' END) AS codes,
 [(len(embedding)-i)/2.0::DOUBLE-1 FOR i IN range(0, greatest(vec_id%7*9-2, 0))] AS days_before_prediction,
 list_transform(embedding[1:3], lambda x: x::DOUBLE*10) AS delta_days,
 list_transform(embedding, lambda x: CASE WHEN x >= -0.2::DOUBLE THEN x::DOUBLE END) AS numeric_values FROM embeddings""",
    ),
    "v_packed_events": (
        ["v_packed"],
        """SELECT task, row_id, subject_id, label, split, i AS idx, codes[i+1] AS code,
 greatest(coalesce(days_before_prediction[i+1], 0), 0)::DOUBLE AS day,
 greatest(coalesce(delta_days[i+1], 0), 0)::DOUBLE AS delta, numeric_values[i+1] AS num
 FROM (SELECT *, unnest(range(0, len(codes))) AS i FROM v_packed)""",
    ),
    "v_predictions": (
        [],
        f"""SELECT {_TASK} AS task, family, source, version, model, seed, 'raw' AS calibration, o_orderkey AS row_id,
 o_custkey AS subject_id, (o_orderstatus='F')::INT AS y_true,
 (1+(o_orderkey*(seed-35))%101+(o_orderstatus='F')::INT*w)/256.0::DOUBLE AS risk
 FROM orders, {_MODELS}, (VALUES (42),(43),(44)) s(seed)""",
    ),
    "v_doc_predictions": (
        [],
        """SELECT d.doc_id AS row_id, regexp_extract(source, '(\\d+)', 1)::BIGINT AS subject_id,
 length(text)/(length(text)+2000.0::DOUBLE) AS risk, t.task, CASE t.task WHEN 'quality' THEN quality ELSE toxic END AS y_true
 FROM documents d JOIN labels l ON d.doc_id=l.doc_id, (VALUES ('quality'),('toxic')) t(task)""",
    ),
    "v_audit": (
        [],
        f"""SELECT {_TASK} AS task, o_orderkey AS row_id, o_custkey AS subject_id,
 CASE WHEN o_custkey%10<=3 THEN 'train' WHEN o_custkey%10<=5 THEN 'tuning' ELSE 'held_out' END AS split,
 (o_orderstatus='F')::INT AS label, coalesce(n-1,0)::DOUBLE AS repeat_removed_first_last,
 coalesce(n,0)::DOUBLE AS raw_sequence_length_non_static, coalesce(m,0)::DOUBLE AS n_diag_codes_persistent_365d
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) n, max(l_linenumber) m FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey""",
    ),
    "v_thresholds": (
        ["v_audit"],
        """SELECT task, quantile_cont(repeat_removed_first_last, 0.9) AS thr, count(*) AS n FROM v_audit
 WHERE split='held_out' GROUP BY task""",
    ),
    "v_audit_held": (
        ["v_audit", "v_thresholds"],
        """SELECT a.*, thr AS repeat_removed_threshold, repeat_removed_first_last >= thr AS high_repeat_group
 FROM v_audit a JOIN v_thresholds t USING (task) WHERE split='held_out'""",
    ),
    "v_sub": (
        ["v_predictions", "v_audit_held"],
        """SELECT p.*, a.high_repeat_group, CASE WHEN a.high_repeat_group THEN 'high_repeat_top10' ELSE 'other_90' END AS group_name,
 a.repeat_removed_first_last, a.raw_sequence_length_non_static, a.n_diag_codes_persistent_365d
 FROM v_predictions p JOIN v_audit_held a USING (task, row_id, subject_id)""",
    ),
    "v_ensemble": (
        ["v_sub"],
        """SELECT task, family, source, version, model, calibration, high_repeat_group, group_name, row_id, subject_id, y_true,
 avg(risk) AS risk, coalesce(stddev_samp(risk), 0) AS risk_std, count(DISTINCT seed) AS n_seeds FROM v_sub GROUP BY ALL""",
    ),
    "v_base": (
        [],
        f"""SELECT {_TASK} AS task, CASE WHEN o_custkey%10<=4 THEN 'tuning' ELSE 'held_out' END AS split, seed,
 o_orderkey AS row_id, o_custkey AS subject_id, (o_orderstatus='F')::INT AS y_true,
 (1+(o_orderkey*(seed-35))%101+(o_orderstatus='F')::INT*40)/256.0::DOUBLE AS p_tabular,
 (1+(o_orderkey*(seed-31))%101+(o_orderstatus='F')::INT*10)/256.0::DOUBLE AS p_sequence,
 (1+(o_orderkey*(seed-29))%101+(o_orderstatus='F')::INT*20)/256.0::DOUBLE AS p_numeric_sequence
 FROM orders, (VALUES (42),(43)) s(seed)""",
    ),
    "v_fusion": (
        ["v_base"],
        """SELECT task, seed, split, row_id, subject_id, y_true, variant, CASE variant WHEN 'tabular_only' THEN p_tabular
 WHEN 'sequence_only' THEN p_sequence ELSE (p_tabular+p_sequence)/2 END AS risk
 FROM v_base, (VALUES ('tabular_only'),('sequence_only'),('fusion_tabular_sequence')) v(variant) WHERE split='held_out'""",
    ),
    "v_features": (
        ["v_events"],
        """SELECT task, row_id, subject_id, split, (arg_max(code, idx) IN ('SNOMED/error','ICD/purchase'))::INT AS label,
 count(*) FILTER (code='VISIT/OP')::DOUBLE AS n_visit, avg(num) FILTER (code='VISIT/OP') AS mean_visit,
 count(*) FILTER (code='SNOMED/error')::DOUBLE AS n_error, avg(num) FILTER (code='SNOMED/error') AS mean_error,
 count(*) FILTER (code='ICD/purchase')::DOUBLE AS n_purchase, avg(num) FILTER (code='ICD/purchase') AS mean_purchase,
 count(*) FILTER (code='LOINC/click')::DOUBLE AS n_click, avg(num) FILTER (code='LOINC/click') AS mean_click,
 NULL::DOUBLE AS empty, 1.0::DOUBLE AS constant FROM v_events GROUP BY task, row_id, subject_id, split""",
    ),
    "v_embedding": (
        [],
        """SELECT 'vectors' AS task, CASE WHEN vec_id%50%2=0 THEN 'tuning' ELSE 'held_out' END AS split, seed, vec_id AS row_id,
 vec_id%50 AS subject_id, (label<3)::INT AS y_true, (label+vec_id%3)::DOUBLE AS tab__0000, 1.0::DOUBLE AS tab__0001,
 CASE WHEN vec_id%4<>0 THEN (vec_id%11)::DOUBLE END AS tab__0002,
 list_transform(embedding, lambda x: x::DOUBLE+seed*0.01::DOUBLE) AS seq_emb,
 list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE-seed*0.01::DOUBLE) AS numseq_emb
 FROM embeddings, (VALUES (42),(43)) s(seed)""",
    ),
}

_DURATION = """CASE WHEN s<=0 THEN '0' WHEN s<=30 THEN '1_30' WHEN s<=90 THEN '31_90' WHEN s<=180 THEN '91_180'
 WHEN s<=365 THEN '181_365' WHEN s<=730 THEN '366_730' ELSE 'gt730' END"""
_COUNT = "CASE WHEN n<=1 THEN '1' WHEN n=2 THEN '2' WHEN n<=5 THEN '3_5' WHEN n<=10 THEN '6_10' ELSE 'gt10' END"
_RECENCY = """CASE WHEN r<=7 THEN '0_7' WHEN r<=30 THEN '8_30' WHEN r<=90 THEN '31_90' WHEN r<=180 THEN '91_180'
 WHEN r<=365 THEN '181_365' ELSE 'gt365' END"""

for _gap in (1, 3):
    VIEWS[f"v_eras_{_gap}"] = (
        ["v_dedup"],
        f"""SELECT *, sum(CASE WHEN step > {_gap} THEN 1 ELSE 0 END) OVER (PARTITION BY row_id, code ORDER BY idx) AS era FROM (
 SELECT row_id, code, idx, day, num, greatest(lag(day) OVER (PARTITION BY row_id, code ORDER BY idx)-day, 0) AS step
 FROM v_dedup WHERE compressible)""",
    )
    VIEWS[f"v_era_groups_{_gap}"] = (
        [f"v_eras_{_gap}"],
        f"""SELECT *, greatest(d1-d2,0) AS s, greatest(d2,0) AS r FROM (SELECT row_id, code, era, count(*) n, min(idx) i1, max(idx) i2,
 arg_min(day,idx) d1, arg_max(day,idx) d2, arg_min(num,idx) num FROM v_eras_{_gap} GROUP BY ALL)""",
    )
_REST = """SELECT row_id, idx, code, day, num, FALSE AS synthetic FROM v_dedup WHERE NOT compressible
 UNION ALL SELECT row_id, i1, code, d1, num, FALSE FROM {g} WHERE n=1 """
VIEWS["v_condition"] = (
    ["v_dedup", "v_era_groups_1"],
    _REST.format(g="v_era_groups_1")
    + f"""UNION ALL SELECT row_id, i1, 'DX_ERA1_START/'||code, d1, 0, TRUE FROM v_era_groups_1 WHERE n>1
 UNION ALL SELECT row_id, i2+0.0001::DOUBLE, 'DX_ERA1_END/'||code, d2, s, TRUE FROM v_era_groups_1 WHERE n>1
 UNION ALL SELECT row_id, i2+0.0002::DOUBLE, 'DX_ERA1_COUNT_BIN/'||({_COUNT})||'/'||code, d2, n, TRUE FROM v_era_groups_1 WHERE n>1""",
)
VIEWS["v_state"] = (
    ["v_dedup", "v_era_groups_3"],
    _REST.format(g="v_era_groups_3")
    + f"""UNION ALL SELECT row_id, i1, 'DX_STATE3_ONSET/'||code, d1, 0, TRUE FROM v_era_groups_3 WHERE n>1
 UNION ALL SELECT row_id, i2+0.0001::DOUBLE, 'DX_STATE3_ACTIVE/'||code, d2, n, TRUE FROM v_era_groups_3 WHERE n>1
 UNION ALL SELECT row_id, i2+0.0002::DOUBLE, 'DX_STATE3_DURATION_BIN/'||({_DURATION})||'/'||code, d2, s, TRUE FROM v_era_groups_3 WHERE n>1
 UNION ALL SELECT row_id, i2+0.0003::DOUBLE, 'DX_STATE3_COUNT_BIN/'||({_COUNT})||'/'||code, d2, n, TRUE FROM v_era_groups_3 WHERE n>1
 UNION ALL SELECT row_id, i2+0.0004::DOUBLE, 'DX_STATE3_RECENCY_BIN/'||({_RECENCY})||'/'||code, d2, r, TRUE FROM v_era_groups_3 WHERE n>1""",
)
VIEWS["v_versions"] = (
    ["v_flagged", "v_dedup", "v_first_last", "v_condition", "v_state"],
    """SELECT 'raw' AS version, row_id, idx, code, day, num, synthetic FROM v_flagged
 UNION ALL SELECT 'compressed_dedup', row_id, idx, code, day, num, synthetic FROM v_dedup
 UNION ALL SELECT 'compressed_first_last', * FROM v_first_last UNION ALL SELECT 'condition_era_1', * FROM v_condition
 UNION ALL SELECT 'state_duration_3', * FROM v_state""",
)
VIEWS["v_seq"] = (
    ["v_versions", "v_flagged", "v_labels"],
    """SELECT l.task, v.version, l.row_id, l.subject_id, l.split, l.label, seq_len, n_unique_tokens, raw_seq_len,
 raw_seq_len-seq_len AS n_events_removed_vs_raw, n_synthetic_events, c AS n_diagnosis_like_events_raw,
 c AS n_compressible_chronic_events_raw
 FROM (SELECT version, row_id, count(*) AS seq_len, count(DISTINCT code) AS n_unique_tokens,
  count(*) FILTER (synthetic) AS n_synthetic_events FROM v_versions GROUP BY ALL) v
 JOIN (SELECT row_id, count(*) AS raw_seq_len, count(*) FILTER (compressible) AS c FROM v_flagged GROUP BY 1) r USING (row_id)
 JOIN v_labels l USING (row_id)""",
)


def with_views(body: str, *names: str, extra: str = "", swap: dict[str, tuple[list[str], str]] | None = None) -> str:
    """``body`` after the named views and everything they read; ``extra`` holds more CTEs, ``swap`` other bodies."""
    ordered: list[str] = []
    views = {**VIEWS, **(swap or {})}

    def visit(name: str) -> None:
        for dep in views[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({views[n][1]})" for n in ordered]
    if extra:
        parts.append(extra)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def cols(s: str = "", i: str = "", f: str = "") -> str:
    """Select list: plain columns, integers as BIGINT, numbers rounded to 6 places."""
    out = s.split()
    out += [f"CAST({c} AS BIGINT) AS {c}" for c in i.split()]
    out += [f"round(CAST({c} AS DOUBLE), 6)+0.0::DOUBLE AS {c}" for c in f.split()]
    return ", ".join(out)


def ranking_ctes(src: str, keys: str, fracs: list[float], weight: str = "1", clip: bool = False, pct: bool = False) -> str:
    """CTEs ending in ``metrics``: keys, counts, areas, losses, and k_i / e_i per fraction.

    Written row by row and naively: running sums over whole groups, top-k by numbering all rows.
    """
    k = ", ".join(keys.split())
    risk = "least(greatest(risk,1e-6::DOUBLE),1-1e-6::DOUBLE)" if clip else "risk"

    def size(f: float) -> str:
        return f"greatest(1,ceil(n*{round(f * 100)}::DOUBLE/100::DOUBLE))" if pct else f"greatest(1,ceil(n*{f}::DOUBLE))"

    tops = ", ".join(
        f"any_value({size(f)}) AS k_{i}, sum(y*greatest(0,least(w,{size(f)}-(cw-w)))) AS e_{i}" for i, f in enumerate(fracs)
    )
    ctes = f"""m_r AS (SELECT {k}, {risk} AS s, y_true AS y, row_id, CAST({weight} AS BIGINT) AS w,
  least(greatest(risk,1e-6::DOUBLE),1-1e-6::DOUBLE) AS q FROM {src}),
m_s AS (SELECT {k}, s, sum(w*y) AS pos, sum(w*(1-y)) AS neg FROM m_r GROUP BY ALL),
m_c AS (SELECT *, sum(pos) OVER (PARTITION BY {k} ORDER BY s DESC) AS cp, sum(neg) OVER (PARTITION BY {k} ORDER BY s DESC) AS cn FROM m_s),
m_a AS (SELECT {k}, sum(pos) AS tot_pos, sum(neg) AS tot_neg, sum(neg*(cp-pos)+0.5::DOUBLE*pos*neg) AS area,
  sum(pos*cp::DOUBLE/(cp+cn)) AS prec FROM m_c GROUP BY ALL),
m_l AS (SELECT {k}, sum(w*(q-y)*(q-y))/sum(w) AS brier, sum(-w*CASE WHEN y=1 THEN ln(q) ELSE ln(1-q) END)/sum(w) AS logloss FROM m_r GROUP BY ALL),
m_b AS (SELECT *, tot_pos+tot_neg AS n, tot_pos AS n_positive, tot_pos/(tot_pos+tot_neg)::DOUBLE AS event_rate,
  CASE WHEN tot_pos>0 AND tot_neg>0 THEN area/(tot_pos::DOUBLE*tot_neg) END AS auroc,
  CASE WHEN tot_pos>0 AND tot_neg>0 THEN prec/tot_pos END AS auprc
  FROM m_a JOIN m_l USING ({k}))"""
    if not fracs:
        return ctes + f",\nmetrics AS (SELECT * FROM m_b)"
    return (
        ctes
        + f""",
m_o AS (SELECT {k}, y, w, sum(w) OVER (PARTITION BY {k} ORDER BY s DESC, md5(row_id::VARCHAR), row_id
  ROWS UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY {k}) AS n FROM m_r),
m_t AS (SELECT {k}, {tops} FROM m_o GROUP BY ALL),
metrics AS (SELECT * FROM m_b JOIN m_t USING ({k}))"""
    )
