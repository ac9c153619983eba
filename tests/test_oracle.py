"""Every query that has SQL against DuckDB on the smallest tables; the rest must run and give the columns they promise."""

import pytest

import __spark_entry__ as entry
import oracle_check
from loomgraph.plans import registry

SLOW = {"fix_iterated", "transition_compose", "cross_entropy_search", "genetic_search", "beam_search", "p2_hierarchy", "p2_descendants", "closure_batched", "closure_full", "connection_path"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, sf_dir, con, name):
    said = oracle_check.compare(spark, con, name, sf_dir, registry.queries()[name], registry.oracle_sql().get(name))
    assert not said.startswith("FAIL"), said


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
