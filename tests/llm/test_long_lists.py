"""URL lists that no level of a cascade holds, and universes that leave too many false positives."""

import pytest
from pyspark.sql import functions as F

from linkfield.llm.url_filter import Rule, TooLong, build_cascade, filter_urls


def expected(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
        host, _, path = rest.partition("/")
        host, path = host.lower(), "/" + path if "/" in rest else ""
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
    return (best.key, best.action) if best else (None, "allow")


@pytest.fixture(scope="module")
def urls(spark):
    rows = [(k, f"https://w{k % 13}.Site{k % 97}.org/p{k % 7}/x{k}", "own", k) for k in range(3000)]
    rows += [(9001, None, "own", 1), (9002, "no scheme", "own", 2), (9003, "", "own", 3), (9004, "http://site1.org/p1/a", "own", 4), (9004, "http://site1.org/p1/a", "own", 4)]
    return spark.createDataFrame(rows, "page_id long, url string, rule string, key int")


RULES = [Rule(f"site{k}.org", f"/p{k % 7}/", "block" if k % 3 else "allow") for k in range(60)] + [Rule("org", "/p1/", "block"), Rule("w1.site1.org", "/", "allow")]


@pytest.mark.parametrize("max_bits, as_table", [(1 << 27, True), (64, False), (64, True), (1024, False)])
def test_same_rows_at_every_bound(spark, urls, max_bits, as_table):
    rules = spark.createDataFrame([(r.host, r.path, r.action) for r in RULES] + [(None, "/", "block"), ("org", None, "block"), ("org", "/", "other")], "host string, path string, action string") if as_table else RULES
    got = filter_urls(urls, "url", rules, max_bits=max_bits)
    assert got.columns == ["page_id", "url", "rule", "key", "host", "path", "verdict"]
    rows = got.collect()
    assert len(rows) == 3005 and all((r.rule, r.verdict) == expected(r.url, RULES) for r in rows)
    assert sum(r.rule is not None for r in rows) > 400


def test_a_key_of_both_actions_is_blocked(spark, urls):
    both = [Rule("site1.org", "/p1/", "allow"), Rule("site1.org", "/p1/", "block"), *[Rule(f"none{k}.net", "/", "allow") for k in range(20)]]
    for bits in (1 << 27, 64):
        assert {r.verdict for r in filter_urls(urls.where("page_id = 9004"), "url", both, max_bits=bits).collect()} == {"block"}


def test_level_0_is_built_anew_for_a_large_universe(spark, urls):
    listed = spark.createDataFrame([(f"k{k}",) for k in range(5)], "key string")
    universe = spark.range(40000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = build_cascade(listed, universe, max_bits=128)
    assert all(level.n_bits <= 128 for level in cascade.levels) and cascade.levels[0].n_hashes > 7
    assert sorted(r.key for r in universe.where(cascade.contains(F.col("key"))).collect()) == [f"k{k}" for k in range(5)]
    with pytest.raises(TooLong):
        build_cascade(universe, universe, max_bits=128)


def test_empty_tables(spark, urls):
    none = spark.createDataFrame([], "host string, path string, action string")
    assert filter_urls(urls.where("false"), "url", RULES, max_bits=64).count() == 0
    assert {r.verdict for r in filter_urls(urls, "url", none).collect()} == {"allow"}
