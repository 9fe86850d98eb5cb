import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import quality


def counts(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(w)
    return (
        n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside),
        n < 50 or 100 * len(inside) > 50 * n,
    )


def histograms(text, lang):
    text = text or ""
    left, chars = text, []
    for pattern in quality.CLASSES.values():
        n = len(left)
        left = re.sub(pattern, "", left)
        chars.append(n - len(left))
    chars.append(len(left))
    total = sum(chars)
    chars = [c / total for c in chars] if total else None
    if lang not in quality.COMMON:
        return chars, None
    words = re.findall("[^\x20\x09-\x0d]+", text)
    bare = sum(not re.search("[A-Za-z\x80-\U0010ffff]", w) for w in words)
    runs = collections.Counter(re.findall("[a-zà-ÿ]+", text.lower()))
    hits = [runs[w] for w in quality.COMMON[lang]]
    tally = [*hits, bare, max(0, len(words) - sum(hits) - bare)]
    total = sum(tally)
    return chars, ([x / total for x in tally] if total else None)


def distance(p, q):
    def part(a, b):
        return a * math.log2(2 * a / (a + b)) if a > 0 else 0.0

    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q)) / 2))


def expected(docs):
    """Rows (doc_id, counts, base_failed, kept) by plain loops."""
    seen, groups = set(), collections.defaultdict(list)
    own = [(d, counts(t), histograms(t, lang), lang if lang in quality.COMMON else "") for d, t, lang in docs]
    for (d, t, _), (_, c, h, ref) in zip(docs, own):
        if c[0] >= 50 and h[0] and (ref, t) not in seen:
            seen.add((ref, t))
            groups[ref].append(h)
    everyone = [h for g in groups.values() for h in g]
    mean = lambda rows: [sum(x) / len(rows) for x in zip(*rows)]
    refs = {r: (mean([h[0] for h in g]), mean([h[1] for h in g])) for r, g in groups.items() if r}
    refs[""] = (mean([h[0] for h in everyone]), None)
    out = []
    for d, c, (chars, words), ref in own:
        far = c[0] >= 50 and distance(chars, refs[ref][0]) > quality.CHAR_LIMIT
        far |= c[0] >= 100 and words is not None and distance(words, refs[ref][1]) > quality.WORD_LIMIT
        out.append((d, *c, not c[5] and not far))
    return sorted(out, key=str)


def test_against_brute_force(documents):
    docs = [tuple(r) for r in documents.select("doc_id", "text", "lang").collect()]
    rows = quality.verdicts(documents).drop("char_distance", "word_distance").collect()
    want = expected(docs)
    assert sorted((tuple(r) for r in rows), key=str) == want
    assert {r[-1] for r in want} == {True, False}


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality.verdicts(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    got = {r["quality"]: (r["n"], r["kept"]) for r in rows.where("not base_failed").groupBy("quality").agg(
        F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    assert got[1][0] == got[1][1] and got[0][1] < 0.4 * got[0][0]


def test_kept_only_passes_all_columns(documents):
    kept = quality.kept_only(documents)
    assert kept.columns == documents.columns
    want = {r[0] for r in quality.verdicts(documents).where("kept").collect()}
    assert {r[0] for r in kept.select("doc_id").collect()} == want


def test_windows_at_the_edges(spark):
    texts = ["a a a a", "a b c", "a b", "", "a b c x a b c", "a b c a b c a", "x y z " * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r[0] for r in quality.verdicts(docs).orderBy("doc_id").select("n_repeat_words").collect()]
    assert got == [counts(t)[4] for t in texts]


def test_empty(empty):
    assert quality.verdicts(empty).count() == 0


@pytest.mark.parametrize("p, q", [([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.2, 0.8], [0.7, 0.3])])
def test_distance(spark, p, q):
    got = spark.createDataFrame([(p,)], "p array<double>").select(quality.js_distance("p", q)).first()[0]
    assert got == pytest.approx(distance(p, q), abs=1e-12)
