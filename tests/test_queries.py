"""Every registered query against its SQL on the smallest tables."""

import oracle
import pytest

from ledgerline.queries import QUERIES, SQL

SLOW = {"grid_search", "svm_metrics", "svm_rbf_metrics", "boosted_metrics", "boosted_importance", "permutation_importance", "oof_scores", "logistic_odds", "forest_importance", "tree_rules"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf_dir, name):
    n, problems = oracle.compare(spark, con, name, sf_dir)
    assert not problems and n > 0


@pytest.mark.parametrize("name", ["asof_history", "asof_last_record", "asof_latest_date", "nearest_within", "grouped_lists", "stratified_folds", "score_curves"])
def test_split_groups_give_the_same(spark, con, sf_dir, split_groups, name):
    assert oracle.compare(spark, con, name, sf_dir)[1] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
