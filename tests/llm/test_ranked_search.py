import math
import re
from collections import Counter

import pyarrow as pa
import pytest

from evenkeel.llm import ranked_search as r

ITEMS = [
    (1, "That and the one THE two"), (2, None), (3, ""), (4, "zzz-unknown qqq"), (5, "a b c d e f g h i j k l m n o p " * 3), (None, "odd Lines é"),
    (6, "word x" + "x" * 69999), (7, "a"), (7, "b h"), (8, " ".join(f"t{k}" for k in range(100)) + " the of and"),
]


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(x for _, c in counts for x in c)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(terms(t))
    out = []
    for i, xs in own.items():
        found = []
        for d, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x in xs if x in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(i, k + 1, None if d[1] else d[2], -d[0]) for k, d in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, documents, monkeypatch, small):
    if small:
        monkeypatch.setattr(r, "STRIDE", 1)
        monkeypatch.setattr(r, "ITEM_BYTES", 20)
    # Copies of one text under many ids, some larger than the first.
    many = spark.createDataFrame([(k, "odd lines and the a b c") for k in range(950000, 950040)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(many).selectExpr("*", "1 as n", "2 as item", "'x' as terms")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "0 as rank")
    got = sorted((tuple(x) for x in r.search(docs, items).collect()), key=str)
    assert got == brute([(x[0], x[1]) for x in docs.collect()], ITEMS)


def test_empty_tables(spark, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert r.search(empty, items).collect() == []
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert r.search(docs, items.where("false")).collect() == []
    assert r.search(docs.withColumn("text", docs.text.substr(9, 9)), items).collect() == []


def test_masks_below_the_last_place_are_not_scored():
    q = r.make_queries([(1, "rare common")])
    rare = r.hash_words(["rare"], r.ALNUM).hashes[0]
    at = int(q.terms[0] != rare)
    q.weights, q.documents, q.length = r.np.array([1, 1]), 1000, 10000
    q.weights[at] = 5000
    lists = [[at, 1 - at] if k < 20 else [1 - at] for k in range(1000)]
    lists = [sorted(x) for x in lists]
    b = pa.record_batch([pa.array(range(1000), pa.int64()), pa.array([10] * 1000, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array([[1] * len(x) for x in lists], pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "times"])
    best = [[]]
    monkey, r.STRIDE = r.STRIDE, 1
    try:
        assert r.search_block(r._Block(b, q), q, best, 10) == 20
    finally:
        r.STRIDE = monkey
    assert [x[2] for x in best[0]] == list(range(10))
