"""Queries beside their SQL on the smallest tables, and the contract of the entry file."""

import os

import pytest

import __spark_entry__ as entry
from compare import check, connect
from tallyflow.plans import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# all queries are compared by tests/compare.py; here are those that stand for the others
FAST = [
    "cube_filter_agg", "cube_zipped_aggs", "cube_null_keys", "cube_constant_dim", "cube_map_m2m", "cube_map_two_dims",
    "cube_filter_mapped", "cube_densify", "pivot_totals", "labels", "fill_down", "mapping_complete", "code_list_prefix",
    "weights_infer", "conflicts", "observer_priority", "local_indicator", "global_indicator", "characterize",
    "benchmark_ranges", "matrix", "text_functions", "wide_periods", "normalized_csv", "issues_periods", "template_rows",
    "counterparts", "wildcard_relations", "build_interfaces", "sankey_links", "hierarchy_build", "code_list_total",
    "processor_part_of", "interface_types", "cube_numeric_codes", "interface_graph_edges", "processor_graph_edges",
    "match_names", "hierarchy_roots", "value_helpers", "issues_missing_refs", "select_processors", "observer_issues", "solve",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="provided tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", FAST)
def test_query_agrees_with_sql(spark, duck, name):
    verdict = check(spark, duck, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])[2]
    assert verdict == "ok"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["bloc", "speed", "value_sum", "value_countav"]
