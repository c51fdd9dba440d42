from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from roadledger.llm import base, warc


@pytest.mark.parametrize(
    "url, key",
    [
        ("HTTP://User:pw@WWW2.Example.COM:80/A/b?z=1&a=2#top", "com,example)/A/b?a=2&z=1"),
        ("https://a.b.example.org", "org,example,b,a)/"),
        ("https://x.example:8080/p", "example,x:8080)/p"),
        ("no scheme", "no scheme"),
        ("", ""),
        (None, None),
    ],
)
def test_keys(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.url_key(F.col("u"))).first()[0] == key


def test_records_are_gzip_members():
    raw = warc.record(7, "http://x/\r\nevil", "<p>ü</p>")
    fields, body = warc.payload(raw)
    assert body == "<p>ü</p>".encode() and fields["WARC-Target-URI"] == "http://x/%0D%0Aevil" and fields["WARC-Record-ID"] == "<urn:page:7>"
    both = gzip.decompress(raw + warc.record(8, "http://y/", None))
    assert both.count(b"WARC/1.0\r\n") == 2 and both.endswith(b"\r\n\r\n")


def test_every_page_comes_back(spark):
    pages = base.table(spark, "/root/testdata/sf0.01", "pages")
    directory, lines = warc.build(pages, lines=7)
    entries = spark.read.parquet(directory).orderBy("first_key").collect()
    assert sum(e["lines"] for e in entries) == pages.count() and max(e["lines"] for e in entries) == 7
    assert all(a["last_key"] <= b["first_key"] for a, b in zip(entries, entries[1:]))
    htmls = {r["page_id"]: r["html"] for r in pages.collect()}
    index = warc.Captures(directory)
    index.narrow("", "\U0010ffff")
    for r in lines.collect():
        found = [x for x in index.lines(r["key"]) if x[1] == r["page_id"]]
        assert len(found) == 1
        assert warc.payload(index.read(*found[0][2:5]))[1].decode() == htmls[r["page_id"]]
    index.close()


def test_a_crowded_key_and_unknown_ones(spark):
    rows = [(k, "http://hot.example/" if k % 2 else f"http://h{k}.example/", f"<p>{k}</p>") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    directory, _ = warc.build(pages, lines=4)
    keys = spark.createDataFrame([("example,hot)/",), ("example,none)/",), (None,), ("example,h4)/",), ("",), ("zzz",)], "key string")
    out = warc.lookup(keys, directory).collect()
    assert sorted(r["page_id"] for r in out) == sorted([4, *range(1, 60, 2)]) and all(r["sound"] for r in out)
