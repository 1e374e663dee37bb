"""URL verdicts: the check SQL, rules, and a filter so small that it has false positives."""

import pytest
from checking import compare, connect
from pyspark.sql import functions as F

from shelfline.llm import url_filter


def test_query_matches_check(spark, sf):
    assert compare(spark, connect(sf), url_filter.query, url_filter.CHECK, sf) is None


URLS = {
    "http://Example.ORG/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
    "https://a.example.org/en/12?q=1": ("a.example.org", "/en/12", "example.org/en/1", "block"),
    "https://a.example.org/en/2#f": ("a.example.org", "/en/2", "org/", "allow"),
    "ftp://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
    "ftp://x.com/de/y": ("x.com", "/de/y", "com/de/", "block"),
    "http://notcom/de/": ("notcom", "/de/", None, "allow"),
    "http://x.org": ("x.org", "", None, "allow"),
    "http://x.net?a://b/c": ("x.net", "", None, "allow"),
    "http://www.listed.net:80/p/?utm_source=a&k=1#z": ("www.listed.net:80", "/p/", None, "block"),
    "http://listed.net/p": ("listed.net", "/p", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "://": ("", "", None, "allow"),
    "http://\u00c4.net/\u00e4\nb": ("\u00c4.net", "/\u00e4\nb", None, "allow"),
    "http://x.net/" + "p" * 100_000: ("x.net", "/" + "p" * 100_000, None, "allow"),
    None: ("", "", None, "allow"),
}


@pytest.mark.parametrize("a_block, broadcast", [(1_000, 16), (4, 16), (4, 0)])
def test_edge_rows(spark, monkeypatch, a_block, broadcast):
    monkeypatch.setattr(url_filter, "URLS_A_BLOCK", a_block)
    monkeypatch.setattr(url_filter, "BROADCAST_BITS", broadcast)
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("listed.net/p?k=1",), *((f"other{i}.net/",) for i in range(200))], "listed string")
    got = url_filter.judge(pages.unionAll(pages), listed).collect()
    want = [(i, *row) for i, row in enumerate(URLS.values())]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [*want, *want]))
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0)).where("rule is null").collect()} == {"allow"}
    nulls = pages.withColumn("page_id", F.lit(None).cast("long"))
    assert url_filter.judge(nulls, listed).count() == len(URLS)


def test_no_python_on_the_main_path(spark, sf):
    plan = url_filter.query(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("listed", [1, 60, 5_000, 200_000])
def test_false_positives_stay_rare_for_any_list(spark, listed):
    bits = url_filter.block_bits(listed)
    assert listed <= url_filter.URLS_A_BLOCK << bits and 1 << bits <= max(2, listed)
    name = F.concat(F.lit("host"), F.col("id"), F.lit(".net/"))
    words = url_filter.bloom(spark.range(listed).select(name.alias("listed")), bits)
    asked = spark.range(listed, listed + 50_000).select(name.alias("form"))
    found = asked.join(words, url_filter.block_of(F.col("form"), bits) == F.col("block"))
    mask = url_filter.bits_of(F.col("form"))
    assert found.where(F.col("word").bitwiseAND(mask) == mask).count() < 0.01 * 50_000
