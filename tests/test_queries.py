"""Registered link queries against their SQL on the smallest tables."""

import os

import pytest

from linkfield.plans import oracles, queries

DATA = "/root/testdata/sf0.001"
SAMPLE = ("s2_output_paths", "p2_default_uri_filter", "p3_custom_uri_filter", "p7_ocr_tile_plan", "a1_link_messages", "w1_letter_findings", "e1_apply_ocr_engine", "t2_reconstruct_lines", "t5_drop_bare_under_scheme", "t8_match_to_rect", "j2_ocr_escalation_pages", "d1_dedupe_qr", "x1_scan_text", "x3_scan", "x3_scan_with_engine", "x5_relink", "x5_incremental_relink")


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({oracles.oracle_sql()[name]}) q").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_entry_without_the_optional_parts(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", None)
    monkeypatch.setattr(entry, "_pipeline", None)
    assert set(entry.queries()) == set(queries.queries())
    assert entry._optional("linkfield.no_such_part") is None
