"""A few registered queries against their SQL on the smallest scale; all of them: ``python -m tests.compare``."""

import pytest

from graphloom.plans import catalog
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SOME = ("agg1_count_where", "jn1_lookup", "etl12_parse_documents", "ev5_score_answers", "grf3_edition_links", "jn10_link_vocabulary")


def test_every_sql_belongs_to_a_query():
    catalog.load()
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 130


@pytest.mark.parametrize("name", SOME)
def test_query_agrees_with_sql(spark, name):
    catalog.load()
    ok, note = compare(spark, connect(SF), name, SF)
    assert ok, note
