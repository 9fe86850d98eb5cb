import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from evenkeel.llm import packing, token_files
from evenkeel.llm.encode import Encoder
from evenkeel.llm.token_counts import PrefixCounts, prefix_counts, token_counts

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ALPHABET = "abcdefghij ABC  \n\t.,'s<>|&#é ß漢字▁ ́​\x00\x1c\x85　😀0123ЖдΣİ're᠎"


@pytest.fixture(scope="module")
def texts(documents):
    rng = random.Random(3)
    odd = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(1500)]
    odd += ["<|endoftext|> hi", "a  <|endoftext|>b", "<|startoftext|>x", "<s> a </s> <unk>", "x\n\n Y  z", "it's\nwe'll 'sx", ""]
    return odd + [r[0] for r in documents.where("text is not null").select("text").collect()]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_the_librarys(path, texts):
    e = Encoder(path)
    for t, got in zip(texts, e.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t[:80]


def test_counts_are_the_librarys(texts):
    c, sp = PrefixCounts(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [c.total(t) for t in texts] == [len(sp.encode(t)) for t in texts]
    for t in [t[:150] for t in texts[::9]]:
        want = [len(sp.encode(t[:k])) for k in range(len(t) + 1)]
        assert c.prefixes(t) == want
        for budget in (0, 1, len(want) // 3):
            assert c.reach(t, budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_token_counts(documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts(documents, PIECES, 300).collect()
    want = documents.select("doc_id", "text").collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got), key=str) == sorted(
        ((r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 300) for r in want), key=str
    )
    stored = prefix_counts(documents.where("doc_id < 5"), PIECES).collect()
    by_id = {r["doc_id"]: r["n_tokens"] for r in got}
    assert all(r["counts"][-1] == by_id[r["doc_id"]] for r in stored)


def encoded(documents, path, end):
    e = Encoder(path)
    rows = documents.select("doc_id", "text").collect()
    return [(r[0], e.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [end]) for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_round_trip(documents, tmp_path):
    files = token_files.write(documents.select("doc_id", "text"), str(tmp_path / "t"), BYTES, 0)
    got = token_files.read(files).orderBy("start").collect()
    want = encoded(documents, BYTES, 0)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(((d, len(i), crc(i)) for d, i in want), key=str)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    by_id = dict(want)
    for r in got[3::17]:
        with token_files.TokenFile(r["file"]) as f:
            assert f.document(r["frame"]).tolist() == by_id[r["doc_id"]] or r["doc_id"] is None


def test_any_zstandard_reader_reads_the_files(documents, tmp_path):
    import zstandard

    files = token_files.write(documents.select("doc_id", "text"), str(tmp_path / "t"), BYTES, 0).collect()
    data = b""
    for r in sorted(files):
        with open(r["file"], "rb") as f, zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as z:
            data += z.read()
    assert len(data) == 2 * sum(r["tokens"] for r in files)


def test_damage_is_found(documents, tmp_path):
    r = token_files.write(documents.select("doc_id", "text").where("doc_id < 9"), str(tmp_path / "t"), BYTES, 0).first()
    data = bytearray(open(r["file"], "rb").read())
    data[20] ^= 1
    open(r["file"], "wb").write(data)
    with pytest.raises(Exception), token_files.TokenFile(r["file"]) as f:
        list(f.documents())


@pytest.mark.parametrize("length, most_open", [(2048, 64), (64, 3)])
def test_packing(documents, length, most_open):
    rows = packing.pack(documents.repartition(7), WORDS, 1, length, most_open).collect()
    want = encoded(documents, WORDS, 1)
    docs, windows = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    by_id = {}
    for d, ids in want:
        by_id.setdefault(d, []).append(ids)
    for d, pieces in docs.items():
        if len(by_id[d]) > 1:
            assert sum(p["length"] for p in pieces) == sum(map(len, by_id[d]))
            continue
        at, ids = 0, by_id[d][0]
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    assert set(docs) == set(by_id)
    for pieces in windows.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= length
    empty = len(windows) * length - sum(r["length"] for r in rows)
    assert empty <= packing.MOST_EMPTY * len(windows) + length


def test_empty(empty):
    assert token_files.round_trip(empty, BYTES, 0).count() == 0
    assert packing.pack(empty, WORDS, 1).count() == 0
    assert token_counts(empty, PIECES).count() == 0


def test_rows_stay_whole(documents):
    got = token_files.round_trip(documents, BYTES, 0)
    assert got.count() == documents.count()
    assert packing.pack(documents, WORDS, 1).where("start = 0").agg(F.count("*")).first()[0] == documents.count()
