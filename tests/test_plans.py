"""Scale properties of the physical plans (sf0.001 tables)."""

import os
import re

import pytest

import __spark_entry__ as entry_mod

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables missing")
QUERIES = {k: f for k, f in entry_mod.queries().items() if not k.startswith("op") and k != "pipeline"}


def _plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loop_or_cartesian_join(spark):
    for name in sorted(QUERIES):
        plan = _plan(spark, name)
        assert "BroadcastNestedLoopJoin" not in plan, name
        assert "CartesianProduct" not in plan, name


def test_knn_never_shuffles_corpus(spark):
    plan = _plan(spark, "knn_l2")
    assert "MapInPandas" in plan
    # the only shuffle of the search is the top-k merge on the question id,
    # with a partial group limit before it
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == {"qid"}
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["lsa_summary", "lsa_term_weights", "strip_html", "chunk_text", "tool_calls", "hash_embed"])
def test_row_wise_queries_have_no_exchange(spark, name):
    assert "Exchange" not in _plan(spark, name)


def test_unknown_tools_leaves_the_join_to_the_planner(spark):
    logical = QUERIES["unknown_tools"](spark, SF)._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" not in logical and "UnresolvedHint" not in logical


def test_one_session_is_a_pushed_filter(spark):
    assert re.search(r"PushedFilters: \[.*EqualTo\(conv_id,3\)", _plan(spark, "one_session"))


def test_history_spreads_hot_sessions(spark):
    plan = _plan(spark, "session_history")
    assert re.search(r"Exchange hashpartitioning\(conv_id#\d+L, _bucket#\d+L", plan)


def test_scans_read_only_needed_columns(spark):
    plan = _plan(spark, "url_host")
    assert re.search(r"ReadSchema: struct<page_id:bigint,url:string>", plan)
    plan = _plan(spark, "json_extract")
    assert re.search(r"ReadSchema: struct<event_id:bigint,props:string>", plan)
