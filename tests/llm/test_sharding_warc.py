import zlib

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import sharding, warc


def capacity(sizes, shards):
    """Binary search with a greedy walk, in a loop."""
    def fits(c):
        n, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("sizes, shards, tried", [
    ([5, 1, 1, 9, 2, 2, 2, 8, 1], 3, 64), ([1] * 40, 8, 2), ([100, 1, 1, 1], 4, 3), ([7], 8, 64), ([3, 3, 3, 3, 3, 3, 3], 3, 5),
])
def test_smallest_capacity(spark, monkeypatch, sizes, shards, tried):
    monkeypatch.setattr(sharding, "TRIED", tried)
    upto, rows = 0, []
    for s in sizes:
        upto += s
        rows.append((s, upto))
    got, ends = sharding.smallest_capacity(spark.createDataFrame(rows, "size long, upto long").cache(), shards)
    assert got == capacity(sizes, shards) and ends[-1] == sum(sizes)


def test_shards(spark, documents):
    rows = sharding.shard(documents).collect()
    docs = documents.select("doc_id", "text").collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in docs), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == want
    groups, shard_of = {}, {}
    by_id = {r[0]: r[1] for r in docs if r[0] is not None}
    for r in rows:
        if r["doc_id"] is not None:
            text = by_id[r["doc_id"]]
            shard_of.setdefault(text, set()).add(r["shard"])
            groups[text] = groups.get(text, 0) + r["size"]
    assert all(len(s) == 1 for s in shard_of.values())
    loads, slots = {}, {}
    for r in rows:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(loads.values()) <= rows[0]["capacity"] <= -(-sum(loads.values()) // 8) + max(groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(loads) <= set(range(8))
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_a_hot_group_is_whole_and_gapless(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(300)] + [(300 + i, f"t{i}") for i in range(600)], "doc_id long, text string")
    rows = sharding.shard(docs).collect()
    assert len({r["shard"] for r in rows if r["doc_id"] < 300}) == 1
    for k in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))


def test_archives(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    more = [(900, "u", None), (901, "u", ""), (902, None, "x"), (903, "http://a/\r\nb", "x"), (903, "http://a/", "x"), (None, "n", "x"), (None, "n", "only"),
            (None, "n", "only"), (904, "big", "<p>\r\n\r\nWARC/1.1 é" * 9000), (905, "big", "<p>\r\n\r\nWARC/1.1 é" * 9000)]
    pages = pages.unionByName(spark.createDataFrame(more, "page_id long, url string, html string")).selectExpr("*", "1 as sha", "2 as original")
    got = warc.round_trip(pages).drop("url").collect()
    rows = pages.select("page_id", "html").collect()
    least = {}
    for p, h in rows:
        if p is not None:
            least[h or ""] = min(least.get(h or "", p), p)
    want = []
    for p, h in rows:
        h, first = h or "", least.get(h or "")
        refers = first if first is not None and first != p else None
        want.append((p, len(h.encode()), warc.digest(h.encode()), "response" if refers is None else "revisit", refers))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(want, key=str)


def test_records_are_gzip_members_with_fresh_headers(spark, sf, tmp_path):
    import gzip

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    files = warc.write(pages, str(tmp_path / "w"), "2020-01-01T00:00:00Z").collect()
    whole = b"".join(gzip.open(r["file"]).read() for r in files)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == pages.count() and whole.count(b"WARC-Date: 2020-01-01T00:00:00Z") == pages.count()
    heads, block = next(warc.records(files[0]["file"]))
    assert heads["WARC-Record-ID"] == warc.record_id(int(heads["X-Page-Id"])) and block.startswith(b"HTTP/1.1 200 OK")


def test_empty(spark, empty):
    assert sharding.shard(empty).count() == 0
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).agg(F.count("*")).first()[0] == 0
