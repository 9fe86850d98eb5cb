"""The pipeline on the smallest tables against the brute-force versions of its operators, stage by stage."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import test_decontam
import test_jaccard
import test_pii
import test_quality
import test_tokens

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The documents before and after each stage, written and read again between stages."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_the_stages_and_their_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii", "packing"]
    assert all(df.schema.names == stages[0].schema.names and [f.dataType for f in df.schema] == [f.dataType for f in stages[0].schema] for df in stages[1:5])


def test_quality_rules(stages):
    want = test_quality.expected([(r["doc_id"], r["text"], r["lang"]) for r in stages[0].collect()])
    assert texts(stages[1]) == {d: t for d, t in texts(stages[0]).items() if d in {r[0] for r in want if r[-1]}}


def test_near_duplicates(stages):
    before = texts(stages[1])
    want = {d for d, _, c in test_jaccard.expected(sorted(before.items())) if d == c}
    assert texts(stages[2]) == {d: before[d] for d in want}


def test_decontamination(spark, sf, stages):
    before = texts(stages[2])
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {r[0] for r in test_decontam.expected(sorted(before.items()), items) if r[-1]}
    assert texts(stages[3]) == {d: t for d, t in before.items() if d not in hit}


def test_personal_data(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert before.keys() == after.keys()
    for d, t in before.items():
        if not test_pii.plain(t):
            assert after[d] == t
        assert not test_pii.plain(after[d])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_packing(stages):
    want = dict(test_tokens.encoded(stages[4], test_tokens.WORDS, 1))
    got = {}
    for r in stages[5].collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert got.keys() == want.keys()
    for d, pieces in got.items():
        at = 0
        for start, n, crc in sorted(pieces):
            assert start == at and crc == test_tokens.crc(want[d][at : at + n])
            at += n
        assert at == len(want[d])


def test_run_applies_the_stages_in_turn(spark, sf, monkeypatch):
    seen = []

    def stage(k):
        def step(spark, docs, sf_dir):
            seen.append((k, docs.count()))
            return docs.where(f"doc_id % {k} = 0")

        return step

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("two", stage(2)), ("three", stage(3)), ("five", stage(5))])
    assert corpus_pipeline.run(spark, sf).count() == 7 and seen == [(2, 200), (3, 100), (5, 34)]
