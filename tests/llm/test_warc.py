"""WARC archives: the records read back, equal bytes however rows are dealt, and edge rows."""

import glob
import hashlib
import os

import pytest
from checking import compare, connect

from shelfline.llm import warc
from shelfline.llm.common import table


def made(spark, pages, root, **sizes):
    manifest = warc.write(spark, pages, root, **sizes)
    return manifest.orderBy("name").collect(), warc.read(manifest, root).collect()


def digests(root):
    return {os.path.basename(f): hashlib.md5(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{root}/*.gz")}


def test_query_matches_check(spark, sf):
    assert compare(spark, connect(sf), warc.query, warc.CHECK, sf) is None


def test_same_files_however_the_rows_are_dealt(spark, sf, tmp_path):
    pages = table(spark, sf, "pages")
    first, rows = made(spark, pages, str(tmp_path / "a"), shard_bytes=40_000, roll_bytes=12_000)
    second, again = made(spark, pages.repartition(7), str(tmp_path / "b"), shard_bytes=40_000, roll_bytes=12_000)
    assert first == second and digests(tmp_path / "a") == digests(tmp_path / "b") and len(first) > 4
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert sum(f.records for f in first) == pages.count()
    assert {f.name for f in first} == set(digests(tmp_path / "a"))
    assert all(f.bytes <= 12_000 or f.records == 1 for f in first)
    order = [h["WARC-Record-ID"] for f in first for h, _ in warc.records_of(open(tmp_path / "a" / f.name, "rb")) if h["WARC-Type"] != "warcinfo"]
    ids = [int(x.split(":")[2]) for x in order]
    assert ids == sorted(ids)


def test_edge_rows(spark, tmp_path):
    long, short = "é" * 600, "x" * 999
    rows = [
        (1, "http://a/\r\nX: y", long), (2, None, long), (3, "u", short), (4, "u", short), (5, "u", None), (None, "u", long),
        (7, "u", ""), (9, "u", "y" * 3_000_000), (8, "u", long), (8, "u", long), (8, "u", "other"), (None, "u", None),
    ]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    _, found = made(spark, pages, str(tmp_path / "w"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found), key=repr)
    want = sorted(
        [(1, 1200, "revisit", 8), (2, 1200, "revisit", 8), (3, 999, "response", None), (4, 999, "response", None),
         (5, 0, "response", None), (None, 1200, "revisit", 8), (7, 0, "response", None), (9, 3_000_000, "response", None),
         (8, 1200, "response", None), (8, 1200, "response", None), (8, 5, "response", None), (None, 0, "response", None)],
        key=repr,
    )
    assert got == want
    assert all(r.payload_digest == hashlib.sha1((t or "").encode()).hexdigest() for r in found for p, _, t in rows if p == r.page_id and r.payload_bytes == len((t or "").encode()))
    assert made(spark, pages.limit(0), str(tmp_path / "none")) == ([], [])
    nulls = pages.where("page_id is null and html is not null")
    assert [r.record_type for r in made(spark, nulls.unionAll(nulls), str(tmp_path / "nulls"))[1]] == ["response"] * 2


def test_a_broken_record_is_noticed(tmp_path):
    record = warc.member([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Block-Digest", warc.sha1(b"abc"))], b"abd")
    (tmp_path / "f").write_bytes(record)
    with pytest.raises(ValueError):
        list(warc.records_of(open(tmp_path / "f", "rb")))
