"""URL verdicts by host and path rules and a blocked Bloom filter of listed URLs.

A rule (host, path) fits a URL whose host is the rule's or a subdomain of it and whose path starts
with the rule's; the longest rule decides. Any other URL is blocked if its canonical form is on the
list. The list is hashed into a blocked Bloom filter: the hash chooses one 64-bit block and a few
bits in it. A URL whose block lacks one of its bits is not listed and is done; only possible hits
go to the join with the list itself, which removes the false positives. Everything is built-in
functions and joins.

The filter has blocks in proportion to the list, `URLS_A_BLOCK` in each, so its rate of false
positives stays the same (about 1 in 400) for any list. Up to 2 ** `BROADCAST_BITS` blocks it is
broadcast; a larger one is joined on the block, where adaptive execution may split a block that many
pages ask for. The list is counted when the function is called.

In the registered query the list holds the canonical URLs that the crawl fetched under more than one
page, as no table brings a list of its own.

Cases: a null URL or one without `://` has empty host and path, no canonical form, and is allowed;
null ids and repeated rows give a row each; an empty list or table is no special case; other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import table, written

#: (verdict, host, path); fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Listed URLs for each 64-bit block, on average at most.
URLS_A_BLOCK = 4
#: log2 of the blocks that are broadcast at most: 65536 rows of two numbers.
BROADCAST_BITS = 16
#: Bits set in a block for each URL; each is chosen by six bits of the hash.
BITS = 4


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.` and default port, path without trailing `/`, query without utm parameters."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)\z", "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&+", "")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.locate("://", url) > 0, whole)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as `host/path`, and its verdict; null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [
        (((host == h) | host.endswith(f".{h}")) & path.startswith(p), verdict, h + p) for verdict, h, p in ordered
    ]
    if not fits:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    rule = reduce(lambda c, f: c.when(f[0], f[2]), fits[1:], F.when(fits[0][0], fits[0][2]))
    verdict = reduce(lambda c, f: c.when(f[0], f[1]), fits[1:], F.when(fits[0][0], fits[0][1]))
    return rule, verdict


def block_bits(listed: int) -> int:
    """log2 of the blocks for a list of so many URLs."""
    return max(1, (max(1, listed) - 1) // URLS_A_BLOCK).bit_length()


def block_of(url: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(url), 64 - bits)


def bits_of(url: Column) -> Column:
    hashed = F.xxhash64(url)
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(63).cast("int")) for i in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def bloom(listed: DataFrame, bits: int) -> DataFrame:
    """(block, word): the filter's blocks that have bits; at most 2 ** bits rows."""
    blocks = listed.groupBy(block_of(F.col("listed"), bits).alias("block"))
    words = blocks.agg(F.bit_or(bits_of(F.col("listed"))).alias("word"))
    return F.broadcast(words) if bits <= BROADCAST_BITS else words


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages; `listed` holds distinct canonical URLs."""
    url = F.col("url").cast("string")
    host, path = host_of(url), path_of(url)
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(url).alias("form"))
    judged = judged.select("*", rule.alias("rule"), ruled.alias("ruled"))
    done = judged.where(F.col("ruled").isNotNull() | F.col("form").isNull())
    asked = judged.where(F.col("ruled").isNull() & F.col("form").isNotNull())
    bits = block_bits(listed.count())
    asked = asked.join(bloom(listed, bits), block_of(F.col("form"), bits) == F.col("block"), "left")
    possible = F.coalesce(F.col("word").bitwiseAND(bits_of(F.col("form"))) == bits_of(F.col("form")), F.lit(False))
    asked = asked.select("page_id", "host", "path", "form", "rule", possible.alias("possible"))
    kept = ("page_id", "host", "path", "rule")
    missed = asked.where(~F.col("possible")).select(*kept, F.lit("allow").alias("verdict"))
    hits = asked.where("possible").join(listed, F.col("form") == F.col("listed"), "left")
    hits = hits.select(*kept, F.when(F.col("listed").isNotNull(), "block").otherwise("allow").alias("verdict"))
    done = done.select(*kept, F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    return done.unionAll(missed).unionAll(hits)


def fetched_again(pages: DataFrame) -> DataFrame:
    """Canonical URLs of more than one page."""
    forms = pages.select(canonical(F.col("url").cast("string")).alias("listed")).where("listed is not null")
    return forms.groupBy("listed").agg(F.count("*").alias("n")).where("n > 1").select("listed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, written(spark, fetched_again(pages), "listed"))


_HOST = r"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CHECK = rf"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce({_HOST}, '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_replace(regexp_replace(regexp_extract(url, '(?s)^[^#?]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&+', '') AS params
  FROM pages),
forms AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
    regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)\z', '') || regexp_replace(path, '/+\z', '')
    || CASE WHEN params <> '' THEN '?' || params ELSE '' END END AS form
  FROM parts),
often AS (SELECT form FROM forms WHERE form IS NOT NULL GROUP BY form HAVING count(*) > 1),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
ruled AS (
  SELECT f.page_id, f.host, f.path, f.form,
    (SELECT max_by(r.h || r.p, length(r.h || r.p)) FROM rules r WHERE (f.host = r.h OR ends_with(f.host, '.' || r.h)) AND starts_with(f.path, r.p)) AS rule
  FROM forms f)
SELECT page_id, host, path, rule,
  coalesce((SELECT verdict FROM rules r WHERE r.h || r.p = rule), CASE WHEN form IN (SELECT form FROM often) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""
