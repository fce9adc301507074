"""Findings of round 4: each of these failed before its change, but for a page of 50 links, which is the control."""

import duckdb
import pytest
from tarn.operators import html_record
from tarn.plans.catalog import ORACLE, QUERIES


def _pages(spark, tmp_path, rows):
    spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")


def _edges(spark, tmp_path):
    return sorted((r.source or "", r.target, r.n) for r in QUERIES["link_graph"](spark, str(tmp_path)).collect())


@pytest.mark.parametrize("many", [50, 51, 20_000])
def test_link_graph_counts_all_links_of_a_page(spark, tmp_path, many):
    menu = "<nav>" + "".join(f'<a href="/{k}">{k}</a>' for k in range(many)) + "</nav>"
    _pages(spark, tmp_path, [("https://a.com/1", menu), ("https://a.com/2", menu), ("https://b.com:80/1", menu), ("https://c.com/1", "<p>none</p>")])
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert _edges(spark, tmp_path) == sorted(con.execute(ORACLE["link_graph"]).fetchall()) == [("a.com", "a.com", 2 * many), ("b.com", "b.com", many)]


def test_link_graph_names_every_target(spark, tmp_path, monkeypatch):
    """Each domain is linked once a page and comes after the first 50 links; more rows than leave a worker at once."""
    monkeypatch.setattr(html_record, "DOMAINS_AT_ONCE", 7, raising=False)
    html = '<a href="/own">x</a>' * 60 + "".join(f'<article><a href="http://T{k}.com:8080/">x</a></article>' for k in range(300))
    _pages(spark, tmp_path, [("https://a.com/1", html), ("https://a.com/2", html)])
    assert _edges(spark, tmp_path) == sorted([("a.com", "a.com", 120), *(("a.com", f"t{k}.com", 2) for k in range(300))])


def test_link_graph_keeps_the_links_beside_a_faulty_one(spark, tmp_path):
    good = '<a href="/x">x</a><a href="https://b.com/">y</a>'
    odd = ['<a href="http://[bad">z</a>', "<![foo[ z ]]>", '<a href="mailto:me@c.com">z</a>', "<a href>z</a>", ""]
    _pages(spark, tmp_path, [*(("https://a.com/1", o + good) for o in odd), (None, good), ("https://a.com/2", None)])
    assert _edges(spark, tmp_path) == [("", "b.com", 1), ("a.com", "a.com", len(odd)), ("a.com", "b.com", len(odd))]
