"""The driver's contract: entry point, registry and a sample of queries next to their SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tastegrid.plans import catalog
from tools.check import TABLES, compare

SMALL = "/root/testdata/sf0.001"
ROWS_ONLY = {
    "rc20_slim", "rc21_pure_svd", "rc22_implicit_als", "rc22_implicit_als_log", "rc23_explicit_mf", "rc23_nonneg_mf", "rc24_factorization_machine",
    "tx14_clean_review_text",
}


def test_entry(spark):
    assert entry.entry(spark).columns == ["k", "Recall", "nDCG", "HR"]


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize(
    "name",
    ["cl04_reindex", "pf05_iterative_k_core", "sp02_best_timestamp", "rc02_most_popular", "rc08_item_knn", "me00_per_user_values", "me33_rsp", "gr05_knn_graph", "tx11_assign_categories", "kg04_second_hop", "io07_read_attributes", "st02_wilcoxon", "st03_compare_all_metrics_wilcoxon", "gr04_cosine_at_least"],
)
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert compare(got, duck.execute(entry.oracle_sql()[name]).fetchdf()) == ""
