"""Prediction tables: joins, metrics, subgroups, summaries and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query
from catalog.sql import cols, ranking_ctes, with_views
from seqrisk.functions import scalars as P
from seqrisk.operators import filters as X
from seqrisk.operators import joins as J
from seqrisk.operators import ranking as M
from seqrisk.operators import resampling as B
from seqrisk.operators import subgroup as U
from seqrisk.operators import summary as A
from seqrisk.plans.joins import stored

BASE = "auroc auprc brier logloss"
COUNTS = "n n_positive"
TOPS = "top_5pct_precision top_10pct_precision top_20pct_precision"
MODEL = "task family source version model seed"
RUN = "task version model seed calibration"
FRACS = [0.05, 0.10, 0.20]


def _top(names: list[str]) -> str:
    return ", ".join(f"e_{i}/k_{i} AS {n}" for i, n in enumerate(names))


def _metrics_sql(src_view: str, keys: str, fracs, select: str, ints: str = "", src: str | None = None, **kw) -> str:
    text = [k for k in keys.split() if k not in ("seed",)]
    seeds = [k for k in keys.split() if k == "seed"]
    body = f"SELECT {cols(' '.join(text), ' '.join(seeds) + ' ' + ints, '')}, {select} FROM metrics"
    return with_views(body, src_view, extra=ranking_ctes(src or src_view, keys, fracs, **kw))


def _rounded(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)+0.0::DOUBLE AS {name}"


# ------------------------------------------------------------------ scalar functions on scores

_SCALARS = {
    "clip_prob": ("least(greatest(p,1e-6::DOUBLE),1-1e-6::DOUBLE)", lambda p: P.clip_prob(p)),
    "logit": ("ln(least(greatest(p,1e-6::DOUBLE),1-1e-6::DOUBLE)/(1-least(greatest(p,1e-6::DOUBLE),1-1e-6::DOUBLE)))", lambda p: P.logit(p)),
}
for _name, (_sql, _fn) in _SCALARS.items():

    @query(_name, with_views(f"SELECT task, row_id, {_rounded(_sql, 'v')} FROM (SELECT task, row_id, (risk-0.3)*2.5 AS p FROM v_doc_predictions)", "v_doc_predictions"))
    def _scalar(spark, sf_dir, fn=_fn):
        return V.document_predictions(spark, sf_dir).select("task", "row_id", fn((F.col("risk") - 0.3) * 2.5).alias("v"))


@query(
    "sigmoid",
    "SELECT o_orderkey AS row_id, " + _rounded("1/(1+exp(-least(greatest(x,-30),30)))", "clipped") + ", "
    + _rounded("1/(1+exp(-x))", "plain") + " FROM (SELECT o_orderkey, (o_totalprice-250000)/5000 AS x FROM orders)",
)
def sigmoid(spark, sf_dir):
    x = (F.col("o_totalprice") - 250000) / 5000
    return V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), P.sigmoid(x).alias("clipped"), P.sigmoid(x, None).alias("plain")
    )


@query(
    "score_transform",
    with_views(
        "SELECT task, seed::BIGINT AS seed, row_id, " + ", ".join(
            _rounded(f"least(greatest({c},1e-6::DOUBLE),1-1e-6::DOUBLE)", f"{c}_prob") + ", "
            + _rounded(f"ln({c}/(1-{c}))", f"{c}_logit") for c in ("p_tabular", "p_sequence")
        ) + " FROM v_base", "v_base",
    ),
)
def score_transform(spark, sf_dir):
    return V.base_scores(spark, sf_dir).select(
        "task", "seed", "row_id",
        *[P.score_transform(c, m).alias(f"{c}_{m}") for c in ("p_tabular", "p_sequence") for m in ("prob", "logit")],
    )


@query(
    "safe_float",
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(v) AS n_valid, " + _rounded("sum(v)", "total")
    + " FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber%5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE l_quantity::DOUBLE END AS v FROM lineitem) GROUP BY ALL",
)
def safe_float(spark, sf_dir):
    n = F.col("l_linenumber") % 5
    text = F.when(n == 0, "inf").when(n == 1, "NaN").when(n == 2, "n/a").otherwise(F.col("l_quantity").cast("string"))
    rows = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.safe_float(text).alias("v"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("v").alias("n_valid"), F.sum("v").alias("total"))


@query(
    "nonnegative_day",
    "SELECT o_orderkey, " + _rounded("greatest(coalesce(d,0),0)", "day")
    + " FROM (SELECT o_orderkey, CASE WHEN o_orderkey%7=0 THEN NULL ELSE (o_orderkey%100-20)::DOUBLE END AS d FROM orders)",
)
def nonnegative_day(spark, sf_dir):
    d = F.when(F.col("o_orderkey") % 7 == 0, float("nan")).otherwise((F.col("o_orderkey") % 100 - 20).cast("double"))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", P.nonnegative_day(d).alias("day"))


@query(
    "parse_list_cell",
    """SELECT vec_id, CASE vec_id%5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END + (vec_id%5=3)::INT AS n,
 CASE vec_id%5 WHEN 0 THEN label||'|'||vec_id||'|x' WHEN 1 THEN label||'|'||vec_id WHEN 2 THEN 'code '||vec_id WHEN 3 THEN '[broken '||vec_id||']' ELSE '' END AS items FROM embeddings""".replace("THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END + (vec_id%5=3)::INT", "THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END::BIGINT"),
)
def parse_list_cell(spark, sf_dir):
    k, label, vec = F.col("vec_id") % 5, F.col("label").cast("string"), F.col("vec_id").cast("string")
    cell = (
        F.when(k == 0, F.concat(F.lit("["), label, F.lit(", "), vec, F.lit(", 'x']")))
        .when(k == 1, F.concat(F.lit("("), label, F.lit(", '"), vec, F.lit("',)")))
        .when(k == 2, F.concat(F.lit("code "), vec))
        .when(k == 3, F.concat(F.lit("[broken "), vec, F.lit("]")))
    )
    parsed = P.parse_list_cell(cell)
    return V.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(parsed).alias("n"), F.concat_ws("|", parsed).alias("items")
    )


_BINS = {
    "duration_bin": ("CASE WHEN d<=0 THEN '0' WHEN d<=30 THEN '1_30' WHEN d<=90 THEN '31_90' WHEN d<=180 THEN '91_180' WHEN d<=365 THEN '181_365' WHEN d<=730 THEN '366_730' ELSE 'gt730' END", P.duration_bin),
    "count_bin": ("CASE WHEN d<=1 THEN '1' WHEN d=2 THEN '2' WHEN d<=5 THEN '3_5' WHEN d<=10 THEN '6_10' ELSE 'gt10' END", P.count_bin),
    "recency_bin": ("CASE WHEN d<=7 THEN '0_7' WHEN d<=30 THEN '8_30' WHEN d<=90 THEN '31_90' WHEN d<=180 THEN '91_180' WHEN d<=365 THEN '181_365' ELSE 'gt365' END", P.recency_bin),
}
for _name, (_sql, _fn) in _BINS.items():
    _mod = 13 if _name == "count_bin" else 900

    @query(_name, f"SELECT {_sql} AS bin, count(*) AS n FROM (SELECT l_orderkey%{_mod} AS d FROM lineitem) GROUP BY 1")
    def _bin(spark, sf_dir, fn=_fn, mod=_mod):
        rows = V.table(spark, sf_dir, "lineitem").select(fn(F.col("l_orderkey") % mod).alias("bin"))
        return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "subgroup_label",
    "SELECT CASE WHEN f IS NULL THEN 'all' WHEN f THEN 'high_repeat_top10' ELSE 'other_90' END AS group_name, count(*) AS n"
    " FROM (SELECT CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS f FROM orders) GROUP BY 1",
)
def subgroup_label(spark, sf_dir):
    flag = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    rows = V.table(spark, sf_dir, "orders").select(P.subgroup_label(flag).alias("group_name"))
    return rows.groupBy("group_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_model_name",
    with_views(
        "SELECT model, regexp_replace(model, '_numeric$', '') AS base_model, suffix(model, '_numeric') AS use_numeric, count(*) AS n FROM v_predictions GROUP BY ALL",
        "v_predictions",
    ),
)
def split_model_name(spark, sf_dir):
    base, numeric = P.split_model_name("model")
    return V.predictions(spark, sf_dir).groupBy("model", base.alias("base_model"), numeric.alias("use_numeric")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ filters

_PRED = cols("task family source version model calibration", "seed row_id subject_id y_true", "risk")


@query("split_filter", with_views("SELECT " + cols("task split", "row_id subject_id label", "repeat_removed_first_last") + " FROM v_audit WHERE split IN ('tuning','held_out')", "v_audit"))
def split_filter(spark, sf_dir):
    return X.split_filter(V.history_audit(spark, sf_dir), "tuning", "held_out").select(
        "task", "split", "row_id", "subject_id", "label", "repeat_removed_first_last"
    )


def _calibrated(spark, sf_dir):
    both = F.inline(
        F.array(
            F.struct(F.lit("raw").alias("calibration"), F.col("risk").alias("risk")),
            F.struct(F.lit("platt").alias("calibration"), (F.col("risk") * 0.9).alias("risk")),
        )
    )
    pred = V.predictions(spark, sf_dir)
    return pred.select(*[c for c in pred.columns if c not in ("calibration", "risk")], both)


@query("calibration_filter", with_views("SELECT " + _PRED + " FROM (SELECT * REPLACE ('platt' AS calibration, risk*0.9::DOUBLE AS risk) FROM v_predictions)", "v_predictions"))
def calibration_filter(spark, sf_dir):
    return X.calibration_filter(_calibrated(spark, sf_dir), "platt")


CONFIGS = [
    {"key": "urgent_trees", "family": "tabular", "task": "urgent", "version": "tabular_all_features", "model": "trees"},
    {"key": "urgent_raw", "family": "sequence", "task": "urgent", "version": "raw", "model": "rnn"},
    {"key": "urgent_dedup", "family": "sequence", "task": "urgent", "version": "compressed_dedup", "model": "rnn"},
    {"key": "routine_trees", "family": "tabular", "task": "routine", "version": "tabular_all_features", "model": "trees"},
    {"key": "routine_numeric", "family": "numeric_sequence", "task": "routine", "version": "compressed_dedup", "model": "rnn_numeric"},
]
_CONFIG_SQL = "(VALUES " + ",".join(
    f"('{c['key']}','{c['family']}','{c['task']}','{c['version']}','{c['model']}')" for c in CONFIGS
) + ") c(key, family, task, version, model)"


@query("config_semi_join", with_views(f"SELECT {_PRED} FROM v_predictions SEMI JOIN {_CONFIG_SQL} USING (family, task, version, model)", "v_predictions"))
def config_semi_join(spark, sf_dir):
    plain = [{k: v for k, v in c.items() if k != "key"} for c in CONFIGS]
    pred = V.predictions(spark, sf_dir)
    return J.config_semi_join(pred, plain).select(*pred.columns)


@query("task_filter", with_views(f"SELECT {_PRED} FROM v_predictions WHERE task='urgent'", "v_predictions"))
def task_filter(spark, sf_dir):
    return X.task_filter(V.predictions(spark, sf_dir), ["urgent"])


@query("head_limit", with_views("SELECT " + cols("task", "row_id label") + " FROM v_labels ORDER BY row_id LIMIT 100", "v_labels"))
def head_limit(spark, sf_dir):
    return X.head_limit(V.example_labels(V.events(spark, sf_dir)), 100).select("task", "row_id", "label")


@query("seeded_subsample", "SELECT o_orderkey AS row_id, o_custkey AS subject_id FROM orders ORDER BY md5(concat_ws('|', 7, o_orderkey)), o_orderkey LIMIT 1000")
def seeded_subsample(spark, sf_dir):
    rows = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("subject_id"))
    return X.seeded_subsample(rows, 1000, 7)


@query(
    "leakage_check",
    with_views(
        "SELECT split, " + cols("", "n_examples", "min_day") + ", coalesce(min_day < -1e-6, FALSE) AS has_future_events FROM ("
        "SELECT split, count(*) AS n_examples, min(list_min(d)) AS min_day FROM (SELECT split,"
        " [x-(row_id%41) FOR x IN days_before_prediction] AS d FROM v_packed WHERE split<>'tuning'"
        " UNION ALL SELECT split, days_before_prediction FROM v_packed WHERE split='tuning') GROUP BY split)",
        "v_packed",
    ),
)
def leakage_check(spark, sf_dir):
    shift = F.when(F.col("split") == "tuning", 0).otherwise(F.col("row_id") % 41)
    rows = V.packed(spark, sf_dir).withColumn("days_before_prediction", F.transform("days_before_prediction", lambda d: d - shift))
    return X.leakage_check(rows, ["split"])


# ------------------------------------------------------------------ joins


def _one(pred, version, model):
    return pred.where((F.col("version") == version) & (F.col("model") == model))


def _pairs(spark, sf_dir):
    pred = V.predictions(spark, sf_dir)
    sides = _one(pred, "compressed_dedup", "rnn"), _one(pred, "raw", "rnn")
    return J.paired_join(*sides, keys=["task", "seed", "row_id", "subject_id", "y_true"])


_PAIR = """a AS MATERIALIZED (SELECT * FROM v_predictions WHERE model='rnn' AND version='compressed_dedup'),
b AS MATERIALIZED (SELECT * FROM v_predictions WHERE model='rnn' AND version='raw'),
pairs AS (SELECT a.task, a.seed, a.row_id, a.subject_id, a.y_true, a.risk AS risk_a, b.risk AS risk_b FROM a JOIN b USING (task, seed, row_id, subject_id, y_true))"""


@query("paired_join", with_views("SELECT " + cols("task", "seed row_id subject_id y_true", "risk_a risk_b") + " FROM pairs", "v_predictions", extra=_PAIR))
def paired_join(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("three_way_join", with_views("SELECT " + cols("task split", "seed row_id subject_id y_true", "p_tabular p_sequence p_numeric_sequence") + " FROM v_base WHERE row_id%3<>0", "v_base"))
def three_way_join(spark, sf_dir):
    keys = ["task", "split", "seed", "row_id", "subject_id", "y_true"]
    base = V.base_scores(spark, sf_dir)
    numeric = base.select(*keys, "p_numeric_sequence").where(F.col("row_id") % 3 != 0)
    return J.three_way_join(base.select(*keys, "p_tabular"), base.select(*keys, "p_sequence"), numeric, keys)


_HELD = cols("task high_repeat_group", "row_id subject_id label", "repeat_removed_first_last repeat_removed_threshold")


def _audit_held(spark, sf_dir):
    audit = V.history_audit(spark, sf_dir)
    cut = U.high_repeat_threshold(audit, V.TASKS)
    return U.audit_high_repeat(audit, cut, V.TASKS)


@query("threshold_join", with_views(f"SELECT {_HELD} FROM v_audit_held", "v_audit_held"))
def threshold_join(spark, sf_dir):
    return _audit_held(spark, sf_dir).select(
        "task", "high_repeat_group", "row_id", "subject_id", "label", "repeat_removed_first_last", "repeat_removed_threshold"
    )


@query("subgroup_join", with_views(f"SELECT {_PRED}, " + cols("high_repeat_group", "", "repeat_removed_first_last raw_sequence_length_non_static n_diag_codes_persistent_365d") + " FROM v_sub", "v_sub"))
def subgroup_join(spark, sf_dir):
    return _sub(spark, sf_dir)


def _sub(spark, sf_dir):
    return U.subgroup_join(V.predictions(spark, sf_dir), _audit_held(spark, sf_dir))


@query(
    "validated_left_join",
    "SELECT o_orderkey AS row_id, o_custkey AS subject_id, n.n_name AS nation FROM orders LEFT JOIN customer c ON o_custkey=c_custkey AND c_custkey%3<>0 LEFT JOIN nation n ON c_nationkey=n_nationkey",
)
def validated_left_join(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("subject_id"))
    customers = V.table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 != 0).select(
        F.col("c_custkey").alias("subject_id"), F.col("c_nationkey").alias("key")
    )
    nations = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("nation"))
    return J.validated_left_join(J.validated_left_join(orders, customers, ["subject_id"]), nations, ["key"]).drop("key")


_ALIGNED = """o AS MATERIALIZED (SELECT * FROM v_predictions WHERE version<>'raw'),
r AS MATERIALIZED (SELECT * FROM v_predictions WHERE version='raw'),
aligned AS (SELECT o.task, o.model, o.seed, o.calibration, o.version AS compressed_version, 'raw' AS baseline_version, o.row_id, o.subject_id,
 o.y_true, o.risk AS risk_compressed, r.risk AS risk_raw FROM o JOIN r USING (task, model, seed, calibration, row_id, subject_id))"""


@query("align_to_baseline", with_views("SELECT " + cols("task model calibration compressed_version baseline_version", "seed row_id subject_id y_true", "risk_compressed risk_raw") + " FROM aligned", "v_predictions", extra=_ALIGNED))
def align_to_baseline(spark, sf_dir):
    return J.align_to_baseline(V.predictions(spark, sf_dir), "raw")


def _repeated(spark, sf_dir):
    """Predictions loaded twice in part, with an explicit load order."""
    pred = V.predictions(spark, sf_dir)
    again = F.when(F.col("row_id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    twice = pred.select("*", F.explode(again).alias("load_order"))
    return twice.withColumn("risk", F.col("risk") + F.col("load_order") * 0.001)


for _keep, _sign in (("last", "+(CASE WHEN row_id%4=0 THEN 0.001::DOUBLE ELSE 0 END)"), ("first", "")):

    @query(f"dedup_keep_{_keep}", with_views(f"SELECT {_PRED} FROM (SELECT * REPLACE (risk{_sign} AS risk) FROM v_predictions)", "v_predictions"))
    def _dedup(spark, sf_dir, keep=_keep):
        keys = ["task", "family", "source", "version", "model", "seed", "calibration", "row_id", "subject_id"]
        return J.dedup(_repeated(spark, sf_dir), keys, ["load_order"], keep).drop("load_order")


# ------------------------------------------------------------------ metrics

_AUC = {"auroc": M.auroc, "auprc": M.auprc, "brier": M.brier, "logloss": M.logloss}
for _name, _fn in _AUC.items():

    @query(_name, _metrics_sql("v_predictions", RUN, [], _rounded(_name, _name)))
    def _area(spark, sf_dir, fn=_fn):
        return fn(V.predictions(spark, sf_dir), RUN.split())


_COUNT_COLS = "n::BIGINT AS n, n_positive::BIGINT AS n_positive, " + _rounded("event_rate", "event_rate") + ", "
_BASE_COLS = ", ".join(_rounded(c, c) for c in BASE.split())


@query("ranking_metrics", _metrics_sql("v_predictions", RUN, [], _COUNT_COLS + _BASE_COLS))
def ranking_metrics(spark, sf_dir):
    return M.ranking_metrics(V.predictions(spark, sf_dir), RUN.split())


@query("ranking_metrics_documents", _metrics_sql("v_doc_predictions", "task", [], _COUNT_COLS + _BASE_COLS))
def ranking_metrics_documents(spark, sf_dir):
    return M.ranking_metrics(V.document_predictions(spark, sf_dir), ["task"])


_TOP_FRACS = [0.01, 0.05, 0.10, 0.20]
_TOPK = " UNION ALL ".join(
    f"SELECT task, {f}::DOUBLE AS top_frac, k_{i}::BIGINT AS top_k, e_{i}::BIGINT AS events_in_top_k, "
    + _rounded(f"e_{i}/k_{i}", "top_k_event_rate") + ", " + _rounded(f"e_{i}/k_{i}/nullif(event_rate,0)", "top_k_lift") + ", "
    + _rounded(f"e_{i}/nullif(n_positive,0)", "event_capture") + ", " + _rounded("event_rate", "base_event_rate")
    + ", n::BIGINT AS n, n_positive::BIGINT AS n_positive{more} FROM metrics"
    for i, f in enumerate(_TOP_FRACS)
)


@query(
    "topk_table",
    with_views(_TOPK.replace("{more}", ", model, version, seed::BIGINT AS seed"), "v_predictions", extra=ranking_ctes("v_predictions", "task version model seed", _TOP_FRACS)),
)
def topk_table(spark, sf_dir):
    return M.topk_table(V.predictions(spark, sf_dir), ["task", "version", "model", "seed"])


@query("topk_table_documents", with_views(_TOPK.replace("{more}", ""), "v_doc_predictions", extra=ranking_ctes("v_doc_predictions", "task", _TOP_FRACS)))
def topk_table_documents(spark, sf_dir):
    return M.topk_table(V.document_predictions(spark, sf_dir), ["task"])


@query("topk_precision", _metrics_sql("v_predictions", RUN, [0.05], _rounded("e_0/k_0", "precision"), clip=True, pct=True))
def topk_precision(spark, sf_dir):
    return M.topk_precision(V.predictions(spark, sf_dir), RUN.split(), M.percent_limits([5])[0], clip=True)


@query(
    "topk_stats",
    _metrics_sql("v_predictions", RUN, [0.1], _rounded("e_0/k_0", "precision") + ", " + _rounded("e_0/k_0/nullif(event_rate,0)", "lift") + ", " + _rounded("e_0/nullif(n_positive,0)", "event_capture")),
)
def topk_stats(spark, sf_dir):
    return M.topk_stats(V.predictions(spark, sf_dir), RUN.split(), 0.1)


@query(
    "metric_by_name",
    with_views(
        " UNION ALL ".join(f"SELECT task, '{m}' AS metric, {_rounded(e, 'value')} FROM metrics" for m, e in (("auroc", "auroc"), ("logloss", "logloss"), ("top_10pct_precision", "e_0/k_0"))),
        "v_doc_predictions", extra=ranking_ctes("v_doc_predictions", "task", [0.1], clip=True, pct=True),
    ),
)
def metric_by_name(spark, sf_dir):
    pred = V.document_predictions(spark, sf_dir)
    parts = [
        M.metric_by_name(pred, ["task"], m).withColumn("metric", F.lit(m)) for m in ("auroc", "logloss", "top_10pct_precision")
    ]
    return X.union_tables(*parts)


_WIDE = _COUNT_COLS + _BASE_COLS + ", " + ", ".join(
    _rounded(f"e_{i}/k_{i}", f"top{p}_precision") + ", " + _rounded(f"e_{i}/k_{i}/nullif(event_rate,0)", f"top{p}_lift")
    + ", " + _rounded(f"e_{i}/nullif(n_positive,0)", f"top{p}_event_capture") for i, p in enumerate((5, 10, 20))
)


@query("metrics_by_group", _metrics_sql("v_predictions", RUN, FRACS, _WIDE))
def metrics_by_group(spark, sf_dir):
    return M.metrics_by_group(V.predictions(spark, sf_dir), RUN.split(), FRACS)


_LONG_EXPR = {**{m: m for m in M.BASE_METRICS}}
for _i, _p in enumerate((5, 10, 20)):
    _LONG_EXPR[f"top{_p}_precision"] = f"e_{_i}/k_{_i}"
    _LONG_EXPR[f"top{_p}_lift"] = f"e_{_i}/k_{_i}/nullif(event_rate,0)"
    _LONG_EXPR[f"top{_p}_event_capture"] = f"e_{_i}/nullif(n_positive,0)"


def _long_sql(keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, ({e})::DOUBLE AS value FROM metrics" for m, e in _LONG_EXPR.items())


@query(
    "metric_registry",
    with_views(
        f"SELECT task, metric, metric NOT IN ('brier','logloss') AS higher_is_better, {_rounded('value', 'value')} FROM ({_long_sql('task')})",
        "v_doc_predictions", extra=ranking_ctes("v_doc_predictions", "task", FRACS),
    ),
)
def metric_registry(spark, sf_dir):
    wide = M.metrics_by_group(V.document_predictions(spark, sf_dir), ["task"], FRACS)
    names = [m for m, _ in M.metric_registry(FRACS)]
    better = [m for m, higher in M.metric_registry(FRACS) if higher]
    long = M.unpivot_metrics(wide.select("task", *names), ["task"], names)
    return long.withColumn("higher_is_better", F.col("metric").isin(better))


_EVAL = _COUNT_COLS + _BASE_COLS + ", " + ", ".join(_rounded(f"e_{i}/k_{i}", t) for i, t in enumerate(TOPS.split()))
_SUB_KEYS = "task family source version model seed calibration high_repeat_group"


@query("subgroup_metrics", _metrics_sql("v_sub", _SUB_KEYS + " group_name", FRACS, _EVAL))
def subgroup_metrics(spark, sf_dir):
    return _subgroup_metrics(spark, sf_dir)


def _subgroup_metrics(spark, sf_dir):
    rows = _sub(spark, sf_dir)
    out = M.evaluate_predictions(rows, _SUB_KEYS.split())
    return out.withColumn("group_name", P.subgroup_label("high_repeat_group"))


_ENS_KEYS = "task family source version model calibration high_repeat_group group_name"


@query("ensemble_performance", _metrics_sql("v_ensemble", _ENS_KEYS, FRACS, _EVAL))
def ensemble_performance(spark, sf_dir):
    return M.evaluate_predictions(A.ensemble_predictions(_sub(spark, sf_dir)), _ENS_KEYS.split())


@query("evaluate_fusion", _metrics_sql("v_fusion", "task seed variant", FRACS, _EVAL))
def evaluate_fusion(spark, sf_dir):
    return M.evaluate_predictions(V.fusion_predictions(spark, sf_dir), ["task", "seed", "variant"])


@query(
    "rank_models",
    with_views(
        "SELECT task, variant, seed::BIGINT AS seed, " + _rounded("auprc", "auprc") + ", row_number() OVER (PARTITION BY task, seed ORDER BY auprc DESC, variant) AS rank FROM metrics",
        "v_fusion", extra=ranking_ctes("v_fusion", "task seed variant", []),
    ),
)
def rank_models(spark, sf_dir):
    metrics = M.ranking_metrics(V.fusion_predictions(spark, sf_dir), ["task", "seed", "variant"])
    return X.rank_models(metrics.select("task", "seed", "variant", "auprc"), ["task", "seed"])


# ------------------------------------------------------------------ subgroups


@query(
    "high_repeat_threshold",
    with_views("SELECT task, 'held_out' AS threshold_source, 0.9::DOUBLE AS q, " + _rounded("thr", "repeat_removed_threshold") + ", n AS n_source_examples FROM v_thresholds", "v_thresholds"),
)
def high_repeat_threshold(spark, sf_dir):
    return U.high_repeat_threshold(V.history_audit(spark, sf_dir), V.TASKS)


_GROUP_SQL = """SELECT task, row_id, subject_id, label::BIGINT AS label, p::DOUBLE AS repeat_removed_proxy, p >= thr AS high_repeat_group, round(thr,6) AS high_repeat_threshold FROM (
 SELECT *, n_events_removed_vs_raw AS p, quantile_cont(n_events_removed_vs_raw::DOUBLE, 0.9) OVER (PARTITION BY task) AS thr FROM v_seq
 WHERE version='compressed_first_last' AND split='held_out')"""


def _high_repeat(seq):
    """``seq`` is the audit as it was written with the examples."""
    raw = seq.where(F.col("version") == "raw")
    first_last = seq.where(F.col("version") == "compressed_first_last")
    return U.high_repeat_group(raw, first_last, ["early", "late"])


@query("high_repeat_group", with_views(_GROUP_SQL, "v_seq"))
def high_repeat_group(spark, sf_dir):
    return _high_repeat(stored(V.audited_examples(spark, sf_dir, ("raw", "compressed_first_last"))))


@query("subgroup_metrics_pair", _metrics_sql("v_sub", RUN + " high_repeat_group", FRACS, _WIDE))
def subgroup_metrics_pair(spark, sf_dir):
    return U.subgroup_metrics_pair(V.predictions(spark, sf_dir), _audit_held(spark, sf_dir), RUN.split(), FRACS)


# ------------------------------------------------------------------ summaries

_LEN_SQL = """count(*) AS n_examples, count(DISTINCT subject_id) AS n_subjects, sum(label)::BIGINT AS n_positive, round(avg(label),6) AS event_rate,
 round(avg(seq_len),6) AS mean_seq_len, round(median(seq_len),6) AS median_seq_len, round(quantile_cont(seq_len,0.9),6) AS p90_seq_len,
 round(quantile_cont(seq_len,0.95),6) AS p95_seq_len, max(seq_len) AS max_seq_len, round(avg(n_events_removed_vs_raw),6) AS mean_events_removed_vs_raw,
 round(median(n_events_removed_vs_raw),6) AS median_events_removed_vs_raw, round(quantile_cont(n_events_removed_vs_raw,0.9),6) AS p90_events_removed_vs_raw,
 round(avg(n_synthetic_events),6) AS mean_synthetic_events"""


@query("dataset_summary", with_views(f"SELECT task, version, {_LEN_SQL} FROM v_seq GROUP BY task, version", "v_seq"))
def dataset_summary(spark, sf_dir):
    return A.dataset_summary(V.audited_examples(spark, sf_dir))


@query("dataset_summary_by_split", with_views(f"SELECT task, version, split, {_LEN_SQL} FROM v_seq GROUP BY task, version, split", "v_seq"))
def dataset_summary_by_split(spark, sf_dir):
    return A.dataset_summary(V.audited_examples(spark, sf_dir), by_split=True)


_COST = _LEN_SQL.replace("n_subjects", "n_patients").replace("sum(label)::BIGINT AS n_positive, round(avg(label),6) AS event_rate,", "").replace(" round(quantile_cont(seq_len,0.95),6) AS p95_seq_len,", "") + ", round(avg(n_compressible_chronic_events_raw),6) AS mean_compressible_chronic_events_raw"


@query(
    "sequence_cost_summary",
    with_views(
        f"SELECT task, version, grp AS split, {_COST} FROM (SELECT *, 'all' AS grp FROM v_seq UNION ALL SELECT *, 'held_out' FROM v_seq WHERE split='held_out'"
        " UNION ALL SELECT s.*, 'held_out_high_repeat' FROM v_seq s SEMI JOIN (SELECT * FROM grp_rows WHERE high_repeat_group) g USING (task, row_id)) GROUP BY task, version, grp",
        "v_seq", extra=f"grp_rows AS ({_GROUP_SQL})",
    ),
)
def sequence_cost_summary(spark, sf_dir):
    seq = stored(V.audited_examples(spark, sf_dir))
    group = _high_repeat(seq).select("task", "row_id", "high_repeat_group")
    return A.sequence_cost_summary(seq.join(group.hint("merge"), ["task", "row_id"], "left"))


@query(
    "run_sanity",
    with_views(
        "SELECT task, version, model, calibration, count(DISTINCT seed) AS n_seeds, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT seed AS s FROM v_predictions)) AS seeds,"
        " count(*) AS n_rows, count(DISTINCT row_id) AS n_examples, count(DISTINCT subject_id) AS n_patients, sum(y_true)::BIGINT AS n_positive FROM v_predictions GROUP BY ALL",
        "v_predictions",
    ),
)
def run_sanity(spark, sf_dir):
    return A.run_sanity(V.predictions(spark, sf_dir))


def _four(c: str) -> str:
    return ", ".join(_rounded(f"{f}({c})", f"{c}__{n}") for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")))


_SUM_METRICS = BASE.split() + TOPS.split()
_TOP_NAMES = TOPS.split()


@query(
    "seed_summary",
    with_views(
        f"SELECT {', '.join(_ENS_KEYS.split())}, count(DISTINCT seed) AS n_seeds, arg_min(n, seed)::BIGINT AS n, arg_min(n_positive, seed)::BIGINT AS n_positive, "
        + _rounded("arg_min(event_rate, seed)", "event_rate") + ", " + ", ".join(_four(c) for c in _SUM_METRICS)
        + f" FROM (SELECT *, {_top(_TOP_NAMES)} FROM metrics) GROUP BY ALL",
        "v_sub", extra=ranking_ctes("v_sub", _SUB_KEYS + " group_name", FRACS),
    ),
)
def seed_summary(spark, sf_dir):
    return A.seed_summary(_subgroup_metrics(spark, sf_dir), _ENS_KEYS.split(), first=("n", "n_positive", "event_rate"))


@query(
    "metric_mean_std",
    with_views(
        "SELECT task, version, model, calibration, count(DISTINCT seed) AS n_seeds, "
        + ", ".join(_rounded(f"avg({c})", f"{c}_mean") + ", " + _rounded(f"stddev_samp({c})", f"{c}_std") for c in BASE.split())
        + " FROM metrics GROUP BY ALL",
        "v_predictions", extra=ranking_ctes("v_predictions", RUN, []),
    ),
)
def metric_mean_std(spark, sf_dir):
    return _mean_std(spark, sf_dir)


def _mean_std(spark, sf_dir):
    metrics = M.ranking_metrics(V.predictions(spark, sf_dir), RUN.split())
    return A.metric_mean_std(metrics, ["task", "version", "model", "calibration"], BASE.split())


@query(
    "preview_topn",
    with_views(
        "SELECT task, version, model, " + _rounded("avg(auprc)", "auprc_mean") + " FROM metrics GROUP BY ALL ORDER BY task, avg(auprc) DESC LIMIT 5",
        "v_predictions", extra=ranking_ctes("v_predictions", RUN, []),
    ),
)
def preview_topn(spark, sf_dir):
    rows = _mean_std(spark, sf_dir).select("task", "version", "model", "auprc_mean")
    return X.preview_topn(rows, 5, "task", F.desc("auprc_mean"))


_EX = "task family source version model calibration high_repeat_group group_name"


@query("prediction_stability", with_views(f"SELECT {cols(_EX, 'row_id subject_id y_true n_seeds', 'risk_mean risk_std')} FROM (SELECT *, risk AS risk_mean FROM v_ensemble)", "v_ensemble"))
def prediction_stability(spark, sf_dir):
    return A.prediction_stability(_sub(spark, sf_dir))


@query(
    "stability_summary",
    with_views(
        f"SELECT {', '.join(_EX.split())}, count(*) AS n_examples, sum(y_true)::BIGINT AS n_positive, " + _rounded("avg(risk_std)", "mean_prediction_std") + ", "
        + _rounded("median(risk_std)", "median_prediction_std") + ", " + _rounded("quantile_cont(risk_std,0.9)", "p90_prediction_std") + ", "
        + _rounded("quantile_cont(risk_std,0.95)", "p95_prediction_std") + ", " + _rounded("max(risk_std)", "max_prediction_std") + " FROM v_ensemble GROUP BY ALL",
        "v_ensemble",
    ),
)
def stability_summary(spark, sf_dir):
    return A.stability_summary(stored(A.prediction_stability(_sub(spark, sf_dir))))


@query("ensemble_predictions", with_views(f"SELECT {cols(_EX, 'row_id subject_id y_true n_seeds', 'risk risk_std')} FROM v_ensemble", "v_ensemble"))
def ensemble_predictions(spark, sf_dir):
    return A.ensemble_predictions(_sub(spark, sf_dir))


_ENS_BASE = """SELECT task, split, row_id, subject_id, y_true, avg(p_tabular) AS p_tabular, avg(p_sequence) AS p_sequence,
 avg(p_numeric_sequence) AS p_numeric_sequence, -1 AS seed FROM v_base GROUP BY ALL"""


@query("ensemble_base_scores", with_views(f"SELECT {cols('task split', 'row_id subject_id y_true seed', 'p_tabular p_sequence p_numeric_sequence')} FROM ({_ENS_BASE})", "v_base"))
def ensemble_base_scores(spark, sf_dir):
    return A.ensemble_base_scores(V.base_scores(spark, sf_dir))


@query("prediction_counts", with_views("SELECT task, split, seed::BIGINT AS seed, count(*) AS n, sum(y_true)::BIGINT AS n_positive, " + _rounded("avg(y_true)", "event_rate") + " FROM v_base GROUP BY ALL", "v_base"))
def prediction_counts(spark, sf_dir):
    return A.prediction_counts(V.base_scores(spark, sf_dir), ["task", "split", "seed"])


@query("union_tables", with_views("SELECT 'raw' AS kind, task, row_id, " + _rounded("p_tabular", "p_tabular") + ", NULL::DOUBLE AS p_sequence FROM v_base UNION ALL SELECT 'other', task, row_id, NULL, " + _rounded("p_sequence", "p_sequence") + " FROM v_base", "v_base"))
def union_tables(spark, sf_dir):
    base = V.base_scores(spark, sf_dir)
    a = base.select(F.lit("raw").alias("kind"), "task", "row_id", "p_tabular")
    return X.union_tables(a, base.select("p_sequence", "row_id", "task", F.lit("other").alias("kind")))


# ------------------------------------------------------------------ resampling
#
# Full numbers of replicates (1000, in the fusion comparison 2000) and all seeds. The draws come from numpy generators, which SQL
# does not have; tests/test_resampling.py compares with copied rows.


@query("row_bootstrap")
def row_bootstrap(spark, sf_dir):
    return B.paired_delta(_pairs(spark, sf_dir), ["task", "seed"])


@query("cluster_bootstrap")
def cluster_bootstrap(spark, sf_dir):
    return B.cluster_delta(_pairs(spark, sf_dir), ["task", "seed"])


COMPARISONS = [
    {"comparison": "trees_vs_raw", "description": "tabular against raw sequence", "task": "urgent", "a": "urgent_trees", "b": "urgent_raw"},
    {"comparison": "dedup_vs_raw", "description": "compressed against raw sequence", "task": "urgent", "a": "urgent_dedup", "b": "urgent_raw"},
    {"comparison": "trees_vs_numeric", "description": "tabular against numeric sequence", "task": "routine", "a": "routine_trees", "b": "routine_numeric"},
]


@query("pairwise_comparisons")
def pairwise_comparisons(spark, sf_dir):
    return B.pairwise_comparisons(A.ensemble_predictions(_sub(spark, sf_dir)), CONFIGS, COMPARISONS)


@query("format_delta_ci")
def format_delta_ci(spark, sf_dir):
    rows = pairwise_comparisons(spark, sf_dir).where(F.col("metric") == "auprc")
    text = P.format_delta_ci("point_delta_a_minus_b", "ci_low", "ci_high")
    return rows.select("task", "group_name", "comparison", text.alias("delta_auprc_with_ci"))


@query("patient_bootstrap_ci")
def patient_bootstrap_ci(spark, sf_dir):
    return B.patient_bootstrap_ci(V.predictions(spark, sf_dir), ["task", "version", "model", "seed"], FRACS)


_VS_KEYS = ["task", "model", "seed", "calibration"]


@query("paired_vs_baseline")
def paired_vs_baseline(spark, sf_dir):
    aligned = J.align_to_baseline(V.predictions(spark, sf_dir), "raw")
    return B.paired_vs_baseline(aligned, _VS_KEYS, FRACS, subgroup="whole")


@query("paired_vs_baseline_by_subgroup")
def paired_vs_baseline_by_subgroup(spark, sf_dir):
    """In the high-repeat group and outside it."""
    aligned = J.align_to_baseline(V.predictions(spark, sf_dir), "raw")
    return B.paired_vs_baseline_by_subgroup(aligned, _audit_held(spark, sf_dir), _VS_KEYS, FRACS)


_FUSION_CMP = [("tabular_only", "fusion_tabular_sequence"), ("sequence_only", "fusion_tabular_sequence")]
FUSION_DRAWS = 2000


def _fusion(spark, sf_dir):
    pred = V.fusion_predictions(spark, sf_dir)
    paired = J.paired_variants(pred, _FUSION_CMP, ["task", "seed", "row_id", "subject_id", "y_true"])
    return paired, B.fusion_samples(paired, n_draws=FUSION_DRAWS)


@query("fusion_bootstrap")
def fusion_bootstrap(spark, sf_dir):
    paired, samples = _fusion(spark, sf_dir)
    return B.fusion_summary(samples, paired, FUSION_DRAWS)


@query("fusion_bootstrap_ensemble")
def fusion_bootstrap_ensemble(spark, sf_dir):
    """Scores averaged over seeds: a table without a seed, reported under -1."""
    rows = ["task", "row_id", "subject_id", "y_true"]
    mean = V.fusion_predictions(spark, sf_dir).groupBy(*rows, "variant").agg(F.avg("risk").alias("risk"))
    paired = J.paired_variants(mean, _FUSION_CMP, rows)
    return B.fusion_summary(B.fusion_samples(paired, n_draws=FUSION_DRAWS), paired, FUSION_DRAWS)


@query("fusion_bootstrap_samples")
def fusion_bootstrap_samples(spark, sf_dir):
    paired, samples = _fusion(spark, sf_dir)
    units = B.fusion_sample_units(paired, n_draws=FUSION_DRAWS)
    return samples.where(F.col("bootstrap_id") > 0).join(units, [*B.FUSION_KEYS, "bootstrap_id"])


@query("bootstrap_across_seeds")
def bootstrap_across_seeds(spark, sf_dir):
    return A.bootstrap_across_seeds(fusion_bootstrap(spark, sf_dir))


@query(
    "bootstrap_summary",
    with_views(
        "SELECT task, version, model, metric, " + _rounded("avg(value)", "mean") + ", " + _rounded("CASE WHEN count(value)=1 THEN 0 ELSE stddev_samp(value) END", "std") + ", "
        + _rounded("quantile_cont(value,0.025)", "ci_low") + ", " + _rounded("quantile_cont(value,0.975)", "ci_high") + ", count(value) AS n_valid FROM ab GROUP BY ALL",
        "v_predictions", extra=ranking_ctes("v_predictions", "task version model seed", FRACS) + f", ab AS ({_long_sql('task, version, model, seed')})",
    ),
)
def bootstrap_summary(spark, sf_dir):
    wide = M.metrics_by_group(V.predictions(spark, sf_dir), ["task", "version", "model", "seed"], FRACS)
    names = [m for m, _ in M.metric_registry(FRACS)]
    long = M.unpivot_metrics(wide.select("task", "version", "model", "seed", *names), ["task", "version", "model", "seed"], names)
    return B.summarize_draws(long, ["task", "version", "model", "metric"])
