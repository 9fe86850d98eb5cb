import re
from collections import Counter

from evenkeel.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def expected(docs, items, window=10):
    wanted = {}
    for item, text in items:
        if item is None or text is None:
            continue
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(k) for k in wanted}
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = wanted.get(tuple(w[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), decontam.item_hash(list(found)), bool(hit)))
    return sorted(out, key=str)


def answers(found):
    rows = decontam.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_against_brute_force(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    more = spark.createDataFrame([(901, "B c D"), (902, None), (None, "a b c d e f g h i j k"), (903, "word " * 12), (903, "")], "item_id long, text string")
    items = items.unionByName(more)
    docs, asked = [tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()]
    want = expected(docs, asked)
    assert sum(r[5] for r in want) > 4
    assert answers(decontam.decontaminate(documents, items)) == want


def nearby(docs, items, window=10):
    """Items by document of which some window's four rarest words stand within 24 places of the rarest."""
    words = [WORD.findall(lower(t)) for _, t in docs]
    often, wanted = Counter(x for w in words for x in w), {}
    for item, text in items:
        w = WORD.findall(lower(text)) if item is not None else []
        for i in range(max(1, len(w) - window + 1) if w else 0):
            terms = list(dict.fromkeys(w[i : i + window]))
            rare = sorted((t for t in terms if often[t]), key=often.get)[:4]
            if len(rare) == min(4, len(terms)):
                wanted.setdefault(tuple(rare), set()).add(item)
    out = []
    for (doc, _), w in zip(docs, words):
        at, found = {}, set()
        for k, x in enumerate(w):
            at.setdefault(x, []).append(k)
        for rare, own in wanted.items():
            if all(t in at for t in rare) and any(all(any(abs(p - o) <= 24 for o in at[t]) for t in rare[1:]) for p in at[rare[0]]):
                found |= own
        out.append((doc, len(found)))
    return sorted(out, key=str)


def test_proximity_against_brute_force(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    # Edited, turned round, with a word that no text has, and of three words.
    taken = [x for x in WORD.findall(lower(documents.orderBy("doc_id").first()["text"]))][:40]
    more = [(901, " ".join(taken[:10][::-1])), (902, " ".join([*taken[:9], "zzunknown"])), (903, " ".join(taken[2:5])), (904, " ".join(taken[::4]))]
    items = items.unionByName(spark.createDataFrame(more, "item_id long, text string"))
    docs, asked = [tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()]
    want = nearby(docs, asked)
    assert sum(n > 0 for _, n in want) > 10
    got = decontam.digest(decontam.decontaminate(documents, items)).select("doc_id", "n_near").collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_blocks_of_queries_agree(spark, sf, documents, tmp_path):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    index = decontam.build_index(documents.select("doc_id", "text"), str(tmp_path / "index"))
    assert answers(decontam.search(index, items, query_bytes=2000)) == answers(decontam.search(index, items))


def test_empty_tables(spark, sf, empty, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontam.decontaminate(empty, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r[5] for r in answers(decontam.decontaminate(documents, none)))


def test_proximity(spark, documents, tmp_path):
    docs = spark.createDataFrame([(1, "zip alpha x beta x gamma x delta zip"), (2, "alpha " + "x " * 200 + "beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "delta gamma beta alpha")], "item_id long, text string")
    got = {r["doc_id"]: (r["near"], r["spans"]) for r in decontam.decontaminate(docs, items).collect()}
    assert got == {1: ([7], []), 2: ([], [])}


def near_by_rule(docs, items, window=10):
    counts = {}
    for _, t in docs:
        for w in WORD.findall(lower(t)):
            counts[w] = counts.get(w, 0) + 1
    out = {}
    for d, t in docs:
        places = {}
        for i, w in enumerate(WORD.findall(lower(t))):
            places.setdefault(w, []).append(i)
        for item, text in items:
            words = WORD.findall(lower(text))
            for i in range(max(1, len(words) - window + 1) if words else 0):
                own = set(words[i : i + window])
                rare = sorted((w for w in own if w in counts), key=lambda w: counts[w])[: decontam.NEAR_WORDS]
                if len(rare) == min(decontam.NEAR_WORDS, len(own)) and any(
                    all(any(abs(p - x) <= decontam.NEAR_SPAN for x in places.get(w, ())) for w in rare) for p in places.get(rare[0], ())
                ):
                    out.setdefault(d, set()).add(item)
    return {d: sorted(out.get(d, ())) for d, _ in docs}


def test_proximity_of_edited_passages(spark):
    passage = "one two2 three3 four4 five5 six six six seven seven seven eight8 nine nine nine"
    long = " ".join(f"w{i}" for i in range(40))
    docs = [
        (1, passage), (2, "six seven nine " * 3), (3, " ".join(f"w{i}" for i in range(20, 34)) + " x"), (4, "red x blue"),
        (5, "red " + "x " * 40 + "blue"), (6, ""), (7, " ".join(f"w{i}" for i in (0, 9, 18, 39)) + " w0 w9 x"),
    ]
    items = [
        (1, "one two2 unheard three3 four4 five5 six seven nine"), (2, long), (3, "blue red"), (4, "blue unheard"), (5, "unheard of words alone"), (6, "x"),
    ]
    found = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {r["doc_id"]: r["near"] for r in found.collect()}
    assert rows[1] == [1] and 2 in rows[3] and 3 in rows[4] and 3 not in rows[5] and not any({4, 5} & set(x) for x in rows.values())
    assert {r["doc_id"]: r["n_near"] for r in decontam.digest(found).collect()} == {d: len(x) for d, x in rows.items()}
    # Distinct frequencies decide which words are rare; ties are broken by hash, so only items without ties are held against the rule.
    want = near_by_rule(docs, items)
    assert all([i for i in rows[d] if i in (3, 4, 5, 6)] == [i for i in want[d] if i in (3, 4, 5, 6)] for d in rows)


def test_proximity_agrees_over_blocks(spark, sf, documents, tmp_path):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    index = decontam.build_index(documents.select("doc_id", "text"), str(tmp_path / "index"))

    def near(**size):
        return sorted(((r["doc_id"], r["near"]) for r in decontam.search(index, items, **size).collect()), key=str)

    assert near(query_bytes=2000) == near()
