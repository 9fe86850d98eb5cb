import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import collocations as c

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

TEXTS = [
    ("en", "New York is big. new york is Big, New York; is big"), ("en", "new york is big and so is new york is big"), (None, "der die der die der die"),
    ("und", "der die\tder die  der"), ("fr", None), ("fr", ""), ("de", " \t\n,;"), ("de", "a a a a a a a a"), ("en", "x" * 70000 + " y " + "x" * 70000 + " y"),
    ("es", "é ü é ü \U0001f600 é ü \U0001f600 odd\x0bline odd\rline"), ("", "lang is blank lang is blank"), ("en", "one two three four five six one two three four five six"),
]


def brute(rows, least, longest, top, contained=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        around = defaultdict(int)
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        around[p[i:j]] = max(around[p[i:j]], a)
        found = []
        for p, a in often.items():
            if 100 * around[p] < contained * a:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        out += [(lang, r + 1, *x[3:]) for r, x in enumerate(sorted(found)[:top])]
    return sorted(out)


def run(docs, **kw):
    return sorted(tuple(r) for r in c.mine(docs, **kw).collect())


@pytest.mark.parametrize("shards,bits,longest", [(2, 16, 4), (3, 3, 4), (1, 16, 3)])
def test_matches_brute_force(spark, monkeypatch, shards, bits, longest):
    monkeypatch.setattr(c, "FEWEST_BITS", bits)
    monkeypatch.setattr(c, "MOST_BITS", bits)
    monkeypatch.setattr(c, "BLOCK_BYTES", 40)
    rows = TEXTS * 2 + [("en", f"the {k % 3} of new york is big the {k % 2} of") for k in range(30)]
    docs = spark.createDataFrame([(k // 2, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    docs = docs.selectExpr("*", "1 as shard", "2 as n", "'x' as word", "0 as rank")
    assert run(docs, least=3, longest=longest, top=12, shards=shards) == brute(rows, 3, longest, 12)


def test_a_phrase_that_reaches_the_threshold_in_the_last_shard_gets_a_whole_cycle(spark):
    rows = [("en", f"w{k % 40} alpha beta gamma delta w{k % 7}") for k in range(60)]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert run(docs, least=58, top=50, shards=4) == brute(rows, 58, 4, 50)


def test_phrases_of_one_shard_are_spelled_once(spark, monkeypatch):
    monkeypatch.setattr(c, "FEWEST_BITS", 8)
    monkeypatch.setattr(c, "MOST_BITS", 8)
    # Words of all shards, and words that only one text has, in cells that they share.
    rows = [("en", f"alpha beta gamma w{k % 3}") for k in range(30)] + [("en", f"p{k} q{k} r{k} " * 5) for k in range(12)]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert run(docs, least=4, longest=2, top=500, shards=2) == brute(rows, 4, 2, 500)


def test_empty_and_wordless(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string, lang string")) == []
    assert run(spark.createDataFrame([(1, None, "en"), (2, " ", None)], "doc_id long, text string, lang string"), least=1) == []


def test_workers_get_small_batches(spark, monkeypatch):
    """Where the scans run, no worker is handed a batch far above the bound."""
    docs, seen = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('words ', 1000) as text", "'en' as lang"), []

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    def look(*_):
        seen.append(docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0])
        raise InterruptedError

    monkeypatch.setattr(c, "frequent", look)
    before = spark.conf.get(BATCH_CONF)
    with pytest.raises(InterruptedError):
        c.mine(docs)
    assert seen[0] < 2 * 4 * 2**20
    assert spark.conf.get(BATCH_CONF) == before
