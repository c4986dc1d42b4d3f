import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillsight.llm import warc

KIND = "page_id bigint, url string, html string"
BIG = "<p>" + "long enough to be revisited " * 60


def plain(rows, least=1000):
    best = defaultdict(list)
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            best[html].append(i)
    found = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = max(best[html]) if len(data) >= least and best[html] else None
        revisit = top is not None and i != top
        found.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(found, key=repr)


def run(spark, rows, parts=3):
    pages = spark.createDataFrame(rows, KIND).repartition(parts)
    found = warc.through_archives(pages)
    kept = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in found.select("page_id", "payload").collect()}
    assert texts == {i: html or "" for i, _, html in rows}
    return sorted((tuple(r) for r in kept), key=repr)


def pages(n, seed=1):
    draw = random.Random(seed)
    bodies = [BIG + str(k) for k in range(5)] + ["short", None, "", "é" * 499, "é" * 500]
    hosts = ["a.example.com", "B.example.com", "www.example.org:8080", "example", ""]
    return [(k, f"https://{draw.choice(hosts)}/p/{draw.randint(0, n)}?q=a b#top", draw.choice(bodies)) for k in range(n)]


ODD = [
    (900, None, BIG), (901, None, None), (902, "", "x"), (903, "no scheme at all\r\nWith: a break", BIG + "y"), (904, "http://[broken", "z" * 2000),
    (905, "http://h/" + "long" * 400, BIG), (906, "http://h/" + "long" * 400 + "er", BIG), (907, "http://user:pw@H.Example/ü?x", "WARC/1.1\r\n\r\n"),
    (908, "HTTP://h.example", "\r\n\r\n" * 300), (909, "http://same/", BIG), (910, "http://same/", BIG), (911, "https://same/", BIG + "0"),
]


@pytest.mark.parametrize("lines,shard,archive", [(3000, 8192, 1 << 30), (2, 7, 3000), (1, 1, 1)])
def test_every_page_comes_back(spark, monkeypatch, lines, shard, archive):
    for name, value in (("BLOCK_LINES", lines), ("SHARD_CAPTURES", shard), ("ARCHIVE_BYTES", archive)):
        monkeypatch.setattr(warc, name, value)
    rows = pages(60) + ODD
    assert run(spark, rows) == plain(rows)


def test_ties_repeats_and_missing_ids(spark):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (2, "http://a/2", BIG), (2, "http://a/other", BIG), (None, "http://a/3", BIG), (None, None, "short")]
    made = warc.through_archives(spark.createDataFrame(rows, KIND), with_payload=False)
    found = made.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain(rows)
    alone = [(None, "http://a/3", BIG), (None, "http://a/4", BIG)]
    made = warc.through_archives(spark.createDataFrame(alone, KIND), with_payload=False)
    assert [r["record_type"] for r in made.collect()] == ["response"] * 2


def test_lookup_reads_only_what_is_asked(spark, monkeypatch):
    for name, value in (("BLOCK_LINES", 3), ("SHARD_CAPTURES", 20)):
        monkeypatch.setattr(warc, name, value)
    rows = [(k, f"http://h{k % 7}.example.com/{k // 2}", f"body {k}") for k in range(200)]
    index = warc.archived(spark.createDataFrame(rows, KIND))
    assert len(index.shards) > 5
    asked = spark.createDataFrame([("https://H3.example.com/1#x",), ("http://h3.example.com/1",), ("http://nowhere/",), ("",)], "url string")
    places = warc.lookup(index, asked)
    found = warc.read_records(index, places).collect()
    assert [(r["page_id"], bytes(r["payload"])) for r in found] == [("3", b"body 3")]
    assert warc.lookup(index, asked.where("url = 'http://nowhere/'")).count() == 0


def test_archives_are_plain_warc_files(spark):
    rows = [(k, f"http://a/{k}", BIG if k % 2 else f"body {k}") for k in range(10)]
    index = warc.archived(spark.createDataFrame(rows, KIND).repartition(2))
    records = []
    for file in Path(index.archives).glob("*.warc.gz"):
        data = file.read_bytes()
        while data:
            member = zlib.decompressobj(31)
            records.append(warc.parsed(member.decompress(data)))
            data = member.unused_data
    assert len(records) == 10 and sum(f["warc-type"] == b"revisit" for f, _ in records) == 4
    revisit = next(f for f, _ in records if f["warc-type"] == b"revisit")
    response = next(f for f, p in records if p == BIG.encode())
    assert revisit["warc-refers-to"] == response["warc-record-id"] and revisit["warc-payload-digest"] == response["warc-payload-digest"]
    assert revisit["refers-to-page-id"] == b"9" and revisit["warc-refers-to-target-uri"] == b"http://a/9"


def test_damage_is_noticed(spark):
    index = warc.archived(spark.createDataFrame([(1, "http://a/", "body of the page")], KIND))
    places = warc.lookup(index, spark.createDataFrame([("http://a/",)], "url string"))
    with pytest.raises(Exception, match="WARC|header|data"):
        warc.read_records(index, places.withColumn("length", F.col("length") - 9)).collect()


def test_directories_hold_short_keys(spark):
    assert list(warc.within([b"a", b"c", b"c"], [b"b", b"c", b"d"], b"c")) == [1, 2]
    assert list(warc.within([b"b"], [b"c"], b"a")) == []
    long = b"k" * 600
    assert list(warc.within([long[:512]], [long[:512]], long + b"x")) == [0]


def test_keys():
    assert warc.capture_key(b"https://u:p@WWW.Example.com:81/a?b#c") == b"com,example,www:81)/a?b"
    assert warc.capture_key(b"http://h") == b"h)/" and warc.capture_key(b"nothing") == b"nothing" and warc.capture_key(b"") == b""
    assert warc.clean_uri("http://a/b c\r\nd") == b"http://a/b%20c%0D%0Ad" and warc.clean_uri(None) == b""


def test_edges(spark):
    empty = spark.createDataFrame([], KIND)
    assert warc.through_archives(empty).count() == 0
    odd = spark.createDataFrame([(1, "http://a/", "x" * 3000), (2, "http://b/", "x" * 3000)], KIND).selectExpr(
        "page_id", "url", "html", "'k' as key", "1 as digest", "2 as id", "3 as payload", "4 as file", "5 as response"
    )
    found = warc.through_archives(odd).orderBy("page_id").collect()
    assert [(r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found] == [("revisit", 2, 3000), ("response", None, 3000)]
