"""A sample of the registered queries against their SQL; tests/compare.py runs all of them."""

import compare
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [
    "s4_dedup_raw", "p1_parse_messages", "p9_merge_urls", "a4_received_spf_fallback",
    "h12_hop_delay", "o6_tripwire_notes", "g8_classify_infra", "g3_geo_range_join_overlaps",
    "l11_rank_candidates", "l15_artifacts", "d12_flag_list", "d17_detection_confidence",
    "f3_risk_reasons", "f9_final_report", "s11_list_reports",
])
def test_query_matches_its_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries

    found = compare.difference(queries()[name](spark, SF), compare.connect(SF), oracle_sql()[name])
    assert found is None, found


def test_every_sql_has_a_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
