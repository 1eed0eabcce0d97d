"""Every query with SQL gives what DuckDB gives."""

import pytest

import __spark_entry__ as entry
from chorale.plans.oracle import SQL
from chorale.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf_dir, as_rows, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert as_rows(ours) == as_rows(theirs)


@pytest.mark.parametrize("name", ["mfcc_features", "spectral_features", "prosodic_features", "encoder_layers", "fusion_pca", "pca_2d", "discriminant_2d", "umap_2d", "logreg_probe", "gbt", "grid_search", "layer_comparison", "bakeoff"])
def test_other_queries_run(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir).toPandas()
    assert len(out)
    if "error" in out:
        assert out["error"].isna().all()


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() == 16
    assert set(entry.oracle_sql()) <= set(entry.queries())
