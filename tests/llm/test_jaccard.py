import itertools
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import jaccard
from evenkeel.llm.graph import components
from evenkeel.session import materialise

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def expected(docs):
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def rows(found):
    return sorted((tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.fixture(scope="module")
def found(documents):
    return materialise(jaccard.near_duplicates(documents))


def test_against_brute_force(documents, found):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert rows(found) == expected(docs)


@pytest.mark.parametrize("leader_rows, small", [(20_000, 8), (3, 2)])
def test_chains_copies_and_shared_passages(spark, monkeypatch, leader_rows, small):
    monkeypatch.setattr(jaccard, "LEADER_ROWS", leader_rows)
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng, docs = random.Random(5), []
    passage = [f"p{i}" for i in range(60)]
    base = [f"w{i}" for i in range(100)]
    for _ in range(40):  # a chain of edits: neighbours are linked, the ends are not
        base = list(base)
        base[rng.randrange(100)] = f"e{rng.random()}"
        docs.append(" ".join(base))
    for i in range(40):
        docs.append(" ".join(passage + [f"t{i}.{k}" for k in range(rng.choice((3, 8, 14, 40)))]))
    docs += docs[:30] + ["only four words here"] * 5
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(jaccard.near_duplicates(frame)) == expected(docs)


def test_empty(empty):
    assert jaccard.near_duplicates(empty).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_one_row_of_each_component_stays(documents, found):
    """Against the links of the brute force, by id and class."""
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    kept = jaccard.without_near_duplicates(documents)
    assert kept.columns == documents.columns
    kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    wordless = [r for r in rows if not (r[1] or "").split()]
    assert sorted((r for r in kept if not (r[1] or "").split()), key=str) == sorted(wordless, key=str)
    want = {c for d, n, c in expected(rows) if n and d is not None}
    assert sorted(d for d, t in kept if (t or "").split()) == sorted(want)
    assert set(kept) <= set(rows)


TALL = "a b c d e f g h i j k l m n o p q r s t"
CASES = [
    # The text of the second id that shares its id with a copy of the first stays.
    ([(1, TALL), (1, "quite another text with words of its own here"), (2, "quite another text with words of its own here")],
     [(1, TALL), (1, "quite another text with words of its own here")]),
    ([(5, TALL), (5, TALL), (5, TALL.upper()), (7, TALL)], [(5, TALL.upper())]),
    ([(None, TALL), (9, TALL), (None, "text that no row with an id has at all"), (None, "text that no row with an id has at all")],
     [(9, TALL), (None, "text that no row with an id has at all")]),
    ([(3, None), (3, None), (None, ""), (4, " ")], [(3, None), (3, None), (None, ""), (4, " ")]),
    ([], []),
]


@pytest.mark.parametrize("rows, want", CASES)
def test_clashing_and_missing_ids(spark, rows, want):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class", "'x' as root", "0 as first")
    got = [(r["doc_id"], r["text"]) for r in jaccard.without_near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_workers_get_small_batches(spark, monkeypatch):
    """Where the sets run, no worker is handed a batch far above the bound."""
    docs, seen = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('words ', 1000) as text", "'en' as lang"), []

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    def look(*_):
        seen.append(docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0])
        raise InterruptedError

    monkeypatch.setattr(jaccard, "_stored_sets", look)
    before = spark.conf.get(BATCH_CONF)
    with pytest.raises(InterruptedError):
        jaccard.near_duplicates(docs)
    assert seen[0] < 2 * 4 * 2**20
    assert spark.conf.get(BATCH_CONF) == before


def test_no_table_holds_the_sets(spark, monkeypatch):
    """Sets take eight bytes for each word, more than the texts; what is written stays well below these."""
    rng, written = random.Random(3), []
    texts = [" ".join(f"{rng.randrange(10**6)}" for _ in range(1500)) for _ in range(60)]
    texts += [t + " and more" for t in texts[:20]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    keep = jaccard._Tables.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        written.append(sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(jaccard._Tables, "keep", kept)
    assert rows(jaccard.near_duplicates(frame)) == expected(list(enumerate(texts)))
    assert max(written) < sum(map(len, texts)) / 4


def test_postings_are_shuffled_once(spark):
    kind = "shingle long, part int, parts int, class long, size int, place int"
    postings = spark.createDataFrame([(1, 0, 1, 5, 9, 0), (1, 0, 1, 5, 9, 0), (1, 0, 1, 6, 9, 1), (2, 0, 1, 5, 9, 1), (2, 0, 1, 5, 9, 1), (3, 1, 2, 5, 9, 2)], kind)
    shared = jaccard._shared(postings)
    assert sorted(r[:4] for r in map(tuple, shared.collect())) == [(1, 0, 1, 5), (1, 0, 1, 6), (3, 1, 2, 5)]
    assert shared._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("compared", [1, 512])
def test_classes_without_ids_and_clashing_ids_are_compared(spark, monkeypatch, compared):
    """Texts are found again by the least id of their class: there may be none, or several classes of it."""
    monkeypatch.setattr(jaccard, "COMPARED", compared)
    one, two = ([f"{x}{i}" for i in range(80)] for x in "vw")
    docs = [(None, " ".join(one)), (7, " ".join(one[:79])), (7, " ".join(two)), (None, " ".join(two[1:])), (9, " ".join(two[2:])), (0, "zero " * 9)]
    docs += [(None, " ".join(f"n{i}.{k}" for k in range(9))) for i in range(5)] + [(20 + i, " ".join([*one, f"end{i}"])) for i in range(12)]
    # Other letters make no other class.
    docs += [(40, " ".join(one).upper()), (41, None), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    # The two rows of id 7 are told apart by their number of shingles.
    assert rows(jaccard.near_duplicates(frame)) == expected(docs)
