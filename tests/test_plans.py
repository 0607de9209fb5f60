"""Plan assertions: the physical plans we want at scale."""

import pytest

import __spark_entry__ as E


def plan(spark, df) -> str:
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def plans(spark, sf_small):
    return {name: plan(spark, fn(spark, sf_small)) for name, fn in E.queries().items()}


def test_top1_per_group_limits_before_shuffle(plans):
    p = plans["band_days"]
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p
    assert "WindowGroupLimit" in plans["cell_top"]


def test_topn_is_take_ordered(plans):
    for name in ("top_rows", "top_groups", "sample_rows", "worst_days"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_filters_and_columns_reach_the_scan(plans):
    def pushed(p):
        return " ".join(l for l in p.splitlines() if "PushedFilters" in l)
    p = plans["box_filter"]
    for f in ("IsNotNull(l_orderkey)", "GreaterThanOrEqual(l_discount,0.02)",
              "LessThanOrEqual(l_discount,0.06)", "GreaterThanOrEqual(l_tax,0.01)",
              "LessThanOrEqual(l_tax,0.05)"):
        assert f in pushed(p), f
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_discount:double,l_tax:double>" in p
    d = pushed(plans["date_window"])
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in d and "In(o_orderpriority" in d


def test_no_cross_join_anywhere(plans):
    for name, p in plans.items():
        assert "BroadcastNestedLoopJoin" not in p, name
        assert "CartesianProduct" not in p, name


def test_no_python_in_any_plan(plans):
    for name, p in plans.items():
        for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                     "MapInPandas", "PythonUDF"):
            assert node not in p, (name, node)


def test_partial_aggregation_before_shuffle(plans):
    for name in ("freq_type", "month_rollup", "collapse_lines", "hex_bins", "orphans"):
        p = plans[name]
        assert "partial_count" in p or "partial_sum" in p, name


def test_small_literal_dimension_is_broadcast(plans):
    assert "BroadcastHashJoin" in plans["code_label"]
