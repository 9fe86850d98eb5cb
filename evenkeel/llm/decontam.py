"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of every word of the training texts: one row per block of texts,
with the block's words sorted, and for each the positions where it stands. Texts never straddle blocks
and lie ``GAP`` positions apart, so a phrase found in the position space lies within one text.

``search`` sends the test windows to every block. A window starts from the list of its rarest word over
the whole corpus; the lists of the other words, shifted by their offsets, are intersected with it from rare to
frequent until nothing is left. The same lists answer proximity questions: the ``NEAR_WORDS`` rarest words of any
window of an item, all its words where it has fewer, within ``NEAR_SPAN`` positions of the rarest. Words that the corpus doesn't have can't
be among them; a window with fewer other words than that has no proximity match. Blocks are answered where they lie: nothing is shuffled by word,
so a frequent word or passage is no hot key. Test sets of any size are worked off in blocks of
``QUERY_BYTES``, the only data that is sent to all tasks.

Defined results: a null or empty text has no words and no hits; a null item or item id is no query;
repeated rows are answered each; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import secrets
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.frames import id_and_text, map_batches
from evenkeel.llm.words import ALNUM, blocks, hash_words
from evenkeel.session import scratch_path

WINDOW = 10
GAP = 64
NEAR_WORDS = 4
NEAR_SPAN = 24
QUERY_BYTES = 8_000_000
INDEX = "row bigint, docs array<bigint>, firsts binary, counts binary, words binary, offsets binary, places binary"
_HITS = "row bigint, place int, doc_id bigint, n_words bigint, spans array<int>, items array<bigint>, near array<bigint>"


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the positional index of (doc_id, text) to path and return it."""

    def build(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for part in blocks(texts):
                w = hash_words(texts[part], ALNUM)
                counts = np.diff(w.first)
                firsts = w.first[:-1] + GAP * np.arange(len(counts))
                place = np.arange(len(w.hashes)) + np.repeat(GAP * np.arange(len(counts)), counts)
                order = np.argsort(w.hashes, kind="stable")
                words, offsets = np.unique(w.hashes[order], return_index=True)
                yield [
                    [secrets.randbits(62)], pa.array([ids[part].to_pylist()], pa.list_(pa.int64())),
                    [firsts.astype("<i8").tobytes()], [counts.astype("<i8").tobytes()], [words.astype("<u8").tobytes()],
                    [np.append(offsets, len(order)).astype("<i4").tobytes()], [place[order].astype("<i4").tobytes()],
                ]

    map_batches(docs, build, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


@dataclass
class Queries:
    """Distinct windows over the distinct query words. vocabulary is sorted; windows hold places in it, -1 beyond the end."""

    vocabulary: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    owners: list[list[int]]
    frequency: np.ndarray | None = None
    near: np.ndarray | None = None
    near_owners: list[list[int]] | None = None

    def weigh(self, frequency: np.ndarray) -> None:
        """Take the words' frequencies in the corpus, and choose the rare words of each window: distinct rows, from rare to frequent (of
        equally frequent ones the first in the window), -1 beyond the end."""
        self.frequency = frequency
        owners: dict[tuple[int, ...], set[int]] = {}
        for k, n in enumerate(self.lengths):
            terms, first = np.unique(self.windows[k, :n], return_index=True)
            terms = terms[np.argsort(first)]
            known = terms[frequency[terms] > 0]
            wanted = min(NEAR_WORDS, len(terms))
            if len(known) >= wanted:
                rare = known[np.argsort(frequency[known], kind="stable")[:wanted]]
                owners.setdefault(tuple(rare.tolist()), set()).update(self.owners[k])
        self.near = np.array([(*x, *[-1] * (NEAR_WORDS - len(x))) for x in owners], np.int32).reshape(-1, NEAR_WORDS)
        self.near_owners = [sorted(x) for x in owners.values()]


def make_queries(items: list[tuple[int, str]], window: int = WINDOW) -> Queries:
    """Windows of consecutive words of each item; an item of fewer words is one window."""
    w = hash_words([t for _, t in items], ALNUM)
    vocabulary = np.unique(w.hashes)
    place = np.searchsorted(vocabulary, w.hashes).astype(np.int32)
    owners: dict[bytes, set[int]] = {}
    for k, (item, _) in enumerate(items):
        own = place[w.first[k] : w.first[k + 1]]
        for i in range(max(1, len(own) - window + 1) if len(own) else 0):
            owners.setdefault(own[i : i + window].tobytes(), set()).add(item)
    rows = [np.frombuffer(k, np.int32) for k in owners]
    table = np.full((len(rows), window), -1, np.int32)
    for i, r in enumerate(rows):
        table[i, : len(r)] = r
    return Queries(vocabulary, table, np.array([len(r) for r in rows], np.int32), [sorted(x) for x in owners.values()])


class _Block:
    """One row of the index."""

    def __init__(self, row: dict):
        self.docs = row["docs"]
        self.firsts = np.frombuffer(row["firsts"], "<i8")
        self.counts = np.frombuffer(row["counts"], "<i8")
        self.words = np.frombuffer(row["words"], "<u8")
        self.offsets = np.frombuffer(row["offsets"], "<i4")
        self.places = np.frombuffer(row["places"], "<i4")

    def find(self, vocabulary: np.ndarray) -> np.ndarray:
        """For each query word its place among the block's words, or -1."""
        at = np.searchsorted(self.words, vocabulary)
        at[at == len(self.words)] = 0
        found = self.words[at] == vocabulary if len(self.words) else np.zeros(len(at), bool)
        return np.where(found, at, -1)

    def postings(self, at: int) -> np.ndarray:
        return self.places[self.offsets[at] : self.offsets[at + 1]]

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, places, "right") - 1


def _within(values: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, values)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == values


def _phrases(b: _Block, q: Queries, at: np.ndarray):
    """(window, starts) of the windows that occur in the block."""
    known = np.where(q.windows >= 0, at[q.windows] >= 0, True).all(axis=1)
    for k in np.flatnonzero(known):
        terms = q.windows[k, : q.lengths[k]]
        order = np.argsort(q.frequency[terms], kind="stable")
        starts = b.postings(at[terms[order[0]]]) - order[0]
        for o in order[1:]:
            if not len(starts):
                break
            starts = starts[_within(starts + o, b.postings(at[terms[o]]))]
        if len(starts):
            yield k, starts


def _nearby(b: _Block, q: Queries, at: np.ndarray):
    """(items, texts of the block) where the rare words of one of their windows all stand within NEAR_SPAN places of the rarest."""
    known = np.where(q.near >= 0, at[q.near] >= 0, True).all(axis=1)
    for k in np.flatnonzero(known):
        rare = q.near[k][q.near[k] >= 0]
        places = b.postings(at[rare[0]])
        for t in rare[1:]:
            if not len(places):
                break
            other = b.postings(at[t])
            places = places[np.searchsorted(other, places + NEAR_SPAN, "right") > np.searchsorted(other, places - NEAR_SPAN)]
        if len(places):
            yield q.near_owners[k], np.unique(b.doc_of(places))


def _covered(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Merged spans [start, end, start, end, ...] of a few overlapping ones."""
    out: list[int] = []
    for k in np.argsort(starts, kind="stable"):
        s, e = int(starts[k]), int(ends[k])
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def word_frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each query word stands in the whole corpus; as many numbers as there are query words."""

    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for row in b.to_pylist():
                words, offsets = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["offsets"], "<i4")
                at = np.searchsorted(words, vocabulary)
                at[at == len(words)] = 0
                if len(words):
                    found = words[at] == vocabulary
                    total += np.where(found, offsets[at + 1] - offsets[at], 0)
        here = np.flatnonzero(total)
        if len(here):
            yield [here.tolist(), total[here].tolist()]

    out = np.zeros(len(vocabulary), np.int64)
    counts = map_batches(index.select("words", "offsets"), count, "word int, n bigint")
    for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


def _answer(index: DataFrame, q: Queries) -> DataFrame:
    """For each text: its words, the merged hit spans (in words), and the items found exactly and nearby."""
    sent = index.sparkSession.sparkContext.broadcast(q)

    def answer(batches):
        q = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                at, n = b.find(q.vocabulary), len(b.docs)
                begins, ends, items, near = [], [], {}, {}
                for k, starts in _phrases(b, q, at):
                    begins.append(starts)
                    ends.append(starts + q.lengths[k])
                    for d in np.unique(b.doc_of(starts)):
                        items.setdefault(int(d), set()).update(q.owners[k])
                for own, docs in _nearby(b, q, at):
                    for d in docs:
                        near.setdefault(int(d), set()).update(own)
                spans: dict[int, list[int]] = {}
                if begins:
                    s, e = np.concatenate(begins), np.concatenate(ends)
                    owner = b.doc_of(s)
                    order = np.argsort(owner, kind="stable")
                    s, e, owner = s[order], e[order], owner[order]
                    cuts = np.flatnonzero(np.diff(owner)) + 1
                    for part in np.split(np.arange(len(owner)), cuts):
                        d = int(owner[part[0]])
                        spans[d] = _covered(s[part] - b.firsts[d], e[part] - b.firsts[d])
                yield [
                    [row["row"]] * n, list(range(n)), b.docs, b.counts.tolist(), [spans.get(d, []) for d in range(n)],
                    [sorted(items.get(d, ())) for d in range(n)], [sorted(near.get(d, ())) for d in range(n)],
                ]

    return map_batches(index, answer, _HITS)


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Every indexed text with its exact hits and its proximity matches for all items (item_id, text)."""
    items = items.where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // query_bytes))
    answers = []
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        q = make_queries([tuple(r) for r in block], window)
        q.weigh(word_frequencies(index, q.vocabulary))
        answers.append(_answer(index, q))
    if n == 1:
        return answers[0].drop("row", "place")
    return _joined(answers)


def _joined(answers: list[DataFrame]) -> DataFrame:
    """Answers of several blocks of items, put together text by text."""

    every = answers[0]
    for a in answers[1:]:
        every = every.unionByName(a)

    def join(table):
        rows = table.to_pylist()
        spans = [s for r in rows for s in zip(r["spans"][::2], r["spans"][1::2])]
        merged = _covered(np.array([s for s, _ in spans]), np.array([e for _, e in spans])) if spans else []
        first = rows[0]
        return pa.table(
            {
                "doc_id": pa.array([first["doc_id"]], pa.int64()), "n_words": pa.array([first["n_words"]], pa.int64()),
                "spans": pa.array([merged], pa.list_(pa.int32())),
                "items": pa.array([sorted({i for r in rows for i in r["items"]})], pa.list_(pa.int64())),
                "near": pa.array([sorted({i for r in rows for i in r["near"]})], pa.list_(pa.int64())),
            }
        )

    kind = "doc_id bigint, n_words bigint, spans array<int>, items array<bigint>, near array<bigint>"
    return every.groupBy("row", "place").applyInArrow(join, kind)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, items, near) of every document; the index goes to the shared folder."""
    index = build_index(id_and_text(docs), scratch_path(docs.sparkSession, "index"))
    return search(index, id_and_text(items, "item_id"), window)


def digest(found: DataFrame) -> DataFrame:
    """The counts of a search: words, hit words, items, and a hash of the items' ids in string order."""
    n_hit = F.expr(
        "aggregate(sequence(1, cast(size(spans) / 2 as int)), 0L, (n, k) -> n + spans[2 * k - 1] - spans[2 * k - 2])"
    )
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", F.when(F.size("spans") == 0, F.lit(0).cast("bigint")).otherwise(n_hit).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), F.size("near").cast("bigint").alias("n_near"),
    )


def item_hash(ids: list[int]) -> str:
    """The hash that ``digest`` gives for these items."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without a hit. Rows without an id can't be told apart: they go if one of them has a hit."""
    hit = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["__hit"]), "left_anti")
