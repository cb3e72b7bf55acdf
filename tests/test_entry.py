"""The driver's entry, and the SQL of every query at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from grovekit.plans import catalogue

SMALL = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
FAST = ["knn_cosine_top5", "cluster_stats", "tree_siblings", "node_purity", "dendrogram_purity", "pairwise_f1", "feature_no_match", "text_words", "triplet_loss", "stored_points", "stored_libsvm", "stored_versions", "stored_weights", "linkage_centroid_by_label", "node_score_centroid", "sparse_vectors", "encoded_records", "text_hashed_features", "graph_renamed", "nn_offlimits_same_label", "nn_without_offlimits", "sparse_dot_top3", "multifeature_top5"]


def _plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    return f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)


@here
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@here
@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    want = c.sql(catalogue.ORACLE[name])
    got = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda it: sorted(tuple(_plain(r[k]) or "" for k in range(len(columns))) for r in it)
    order = [want.columns.index(c) for c in columns]
    assert rows(got.select(*columns).collect()) == rows([[r[i] for i in order] for r in want.fetchall()])


def test_every_query_has_a_docstring_or_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    learned = ("online_", "hac_", "knn_lsh", "graph_improved", "learned_", "dev_", "tree_dot", "op", "pipeline")
    assert all(name in sql or q.__doc__ or name.startswith(learned) for name, q in queries.items())
