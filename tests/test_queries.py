"""Every registered query against its SQL twin, also with all series cut."""

import pytest
from compare import connect, differences
from conftest import TINY

import __spark_entry__ as entry_points
from tidemark.plans.oracle import ORACLE
from tidemark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(TINY)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, TINY), con, ORACLE[name]) is None


CUT = [
    "align_end", "align_end_padded", "block_label", "eval_auc_splits", "eval_regression", "forecast_quality",
    "forecast_window_series", "label_join", "overlay_series", "scale_minmax_by_symbol", "scale_minmax_train_with_label",
    "split_chrono", "split_per_file_scale", "stateful_score_batch", "train_windows", "window_model_series",
]


@pytest.mark.parametrize("name", CUT)
def test_equals_sql_when_series_are_cut(spark, con, cut_small, name):
    assert differences(QUERIES[name](spark, TINY), con, ORACLE[name]) is None


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(ORACLE) <= set(QUERIES)


def test_queries_without_sql_are_the_iterative_ones():
    assert set(QUERIES) - set(ORACLE) == {
        "train_avg_softmax", "train_history", "train_avg_recurrent",
        "fit_windows_ml", "classify_vectors_ml", "forecast_trained",
    }


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_iterative_query_gives_rows(spark, name):
    assert QUERIES[name](spark, TINY).count() > 0


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["series_id", "n", "mae", "mse", "rmse"]
    assert df.count() > 0
