"""Fitted models. They have no SQL twin; tests check them against direct solutions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query
from seqrisk.operators import features as W
from seqrisk.operators import joins as J
from seqrisk.operators import models as L
from seqrisk.operators.summary import ensemble_base_scores

ARRAYS = {"seq_emb": ("seq_emb__", V.WIDTH), "numseq_emb": ("numseq_emb__", V.WIDTH)}
SEEDS = (42, 43)


def _features(spark, sf_dir):
    df = V.tabular_features(spark, sf_dir)
    return df, [c for c in W.feature_columns(df) if c not in ("empty", "constant")]


@query("gbt_scores")
def gbt_scores(spark, sf_dir):
    df, columns = _features(spark, sf_dir)
    return L.tabular_scores(df, "HistGradientBoosting", 42, columns)


@query("rf_scores")
def rf_scores(spark, sf_dir):
    df, columns = _features(spark, sf_dir)
    return L.tabular_scores(df, "RandomForest_balanced", 42, columns)


@query("logreg_scores")
def logreg_scores(spark, sf_dir):
    df, columns = _features(spark, sf_dir)
    return L.tabular_scores(df, "LogisticRegression_balanced", 42, columns)


@query("platt")
def platt(spark, sf_dir):
    base = V.base_scores(spark, sf_dir)
    scores = F.inline(
        F.array(
            F.struct(F.lit("trees").alias("model"), F.col("p_tabular").alias("risk")),
            F.struct(F.lit("rnn").alias("model"), F.col("p_sequence").alias("risk")),
        )
    )
    return L.platt(base.select("task", "split", "seed", *L.ROW, scores))


@query("score_fusion")
def score_fusion(spark, sf_dir):
    """Every task and seed, and the ensemble over seeds."""
    base = V.base_scores(spark, sf_dir)
    return L.score_fusion(base.unionByName(ensemble_base_scores(base)), "logit", balanced=True)


def _fusion_features(spark, sf_dir):
    """Every seed, and the ensemble of the seeds under -1."""
    single = V.embedding_features(spark, sf_dir, SEEDS)
    tabs = [c for c in single.columns if c.startswith(W.PREFIXES["tabular"])]
    ensemble = J.ensemble_features(single, tabs, {name: size for name, (_, size) in ARRAYS.items()})
    return single.unionByName(ensemble), [*SEEDS, -1]


@query("embedding_fusion")
def embedding_fusion(spark, sf_dir):
    df, seeds = _fusion_features(spark, sf_dir)
    return L.embedding_fusion(df, ARRAYS, ["vectors"], seeds, c=0.1)


@query("meta_model_sweep")
def meta_model_sweep(spark, sf_dir):
    """All models, variants and seeds."""
    df, seeds = _fusion_features(spark, sf_dir)
    return L.meta_model_sweep(df, ARRAYS, ["vectors"], seeds)


@query("embedding_fusion_metrics")
def embedding_fusion_metrics(spark, sf_dir):
    """Held-out metrics of every fit of the fusion, with what it was fitted on."""
    return L.fusion_metrics(embedding_fusion(spark, sf_dir))
