"""Plan checks: no cartesian products, top-k operators, pushdown to scans."""

from conftest import SF_SMALL

import __spark_entry__ as E
from quire import registry as R
from quire.plans import query as QP


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_product_in_any_query(spark):
    bad = [name for name, fn in R.QUERIES.items() if "CartesianProduct" in _plan(fn(spark, SF_SMALL))]
    assert bad == []


def test_prefixes_are_equi_joins(spark):
    for name in ("match_prefix", "bm25_scores"):
        assert "BroadcastNestedLoopJoin" not in _plan(E.queries()[name](spark, SF_SMALL)).split("Subquery")[0], name


def test_search_pushes_tokens_and_dois(spark):
    plan = _plan(E.queries()["match_term"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,esat)" in plan
    plan = _plan(E.queries()["search_relevance"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan and "LocalTableScan" not in plan


def test_relevance_top_k_operator(spark):
    from quire.operators.match import matched_docs
    from pyspark.sql import functions as F

    c = R.ctx(spark, SF_SMALL)
    top = matched_docs(c.index, QP.build(R.FLAGSHIP_QUERY, R.lookup(spark, SF_SMALL))).orderBy(F.desc("score"), "doi").limit(10)
    assert "TakeOrderedAndProject" in _plan(top)


def test_filters_reach_the_scan(spark):
    plan = _plan(E.queries()["filter_all"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(date,2024-02-10)" in plan and "In(category, [src4,src5,src6])" in plan


def test_batch_top_k_is_partial_before_shuffle(spark):
    plan = _plan(E.queries()["batch_search"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan
