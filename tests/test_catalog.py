"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_queries import TABLES, canonical

SF_DIR = "/root/testdata/sf0.001"
NAMES = [
    "remaining_after_dedup", "compress_versions", "compression_audit", "collect_sequence", "delta_days", "tail_truncate", "build_vocab",
    "choose_codes", "scan_predictions", "scan_with_source_file", "sink_tables", "sink_metadata", "parse_list_cell", "seeded_subsample",
    "topk_table", "metric_by_name", "subgroup_metrics", "seed_summary", "stability_summary", "high_repeat_group", "sequence_cost_summary",
    "align_to_baseline", "paired_join", "usable_columns", "ensemble_features",
]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry_module.queries()[name](spark, SF_DIR).toPandas()
    want = duck.execute(entry_module.oracle_sql()[name]).df()
    assert canonical(got).equals(canonical(want))


def test_entry_is_a_query_and_only_fits_and_draws_lack_sql(spark):
    assert entry_module.entry(spark).columns == ["subject_id", "n_remaining"]
    fits = {"gbt_scores", "rf_scores", "logreg_scores", "platt", "score_fusion", "embedding_fusion", "meta_model_sweep", "embedding_fusion_metrics"}
    draws = {
        "row_bootstrap", "cluster_bootstrap", "pairwise_comparisons", "format_delta_ci", "patient_bootstrap_ci", "paired_vs_baseline",
        "paired_vs_baseline_by_subgroup", "fusion_bootstrap", "fusion_bootstrap_ensemble", "fusion_bootstrap_samples", "bootstrap_across_seeds",
    }
    assert set(entry_module.QUERIES) - set(entry_module.ORACLE) == fits | draws


@pytest.mark.parametrize("name,keys", [("gbt_scores", 2), ("rf_scores", 2), ("embedding_fusion", 18), ("meta_model_sweep", 126)])
def test_fits_score_every_row_once(spark, name, keys):
    out = entry_module.queries()[name](spark, SF_DIR)
    by = [c for c in ("task", "variant", "meta_model", "seed") if c in out.columns]
    assert out.where("risk < 0 or risk > 1 or risk is null").isEmpty()
    assert out.groupBy(*by, "row_id").count().where("count > 1").isEmpty()
    assert out.select(*by).distinct().count() == keys
