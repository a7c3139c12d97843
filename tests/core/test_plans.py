"""Registered plans against their SQL on DuckDB."""

import os

import duckdb
import pytest
from acquira.plans import catalog

SF = "/root/testdata/sf0.001"
#: One of each kind; ACQUIRA_ALL_PLANS=1 runs all.
SOME = ["entropy", "nms_fold", "admissible_gate", "ledger_spend", "discovery", "rank_normalise", "cost_to_reach", "recall_by_group", "exemplar_quota", "region_box_only", "cluster_quality", "verdict_gates", "recall_by_class", "schedule_weights", "infer_introduced", "research_scores", "gate_summary", "known_contamination", "partition_sweep", "pair_similarity", "ceiling_trajectory", "task_rows", "vulnerability", "purchase_row", "prefix_overlap", "detections_scan", "annotations_scan", "results_scan", "coherence_density", "trained_boxes", "epoch_batches", "greedy_batch"]


def rounded(v):
    return round(v, 7) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE) if os.environ.get("ACQUIRA_ALL_PLANS") else SOME)
def test_plan_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(rounded(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want
