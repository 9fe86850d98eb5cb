"""Ranked lexical search by presence masks.

One pass turns each document into its search terms with their numbers of occurrences and its length; only terms of the
items are kept, and the table of them is written once. A task then reads blocks of it. Each term of a block has a
bitmap over the block's documents; the bitmaps of an item's terms, laid side by side, are the documents'
masks of matched terms, and documents with one mask form a group. A mask's highest possible score follows from the best share
that each of its terms has in the block. Masks are evaluated by descending highest score until that is below the
score of the item's last place, which the task keeps from block to block; so nothing that could be placed is passed over. Tasks hand
out at most ``top`` documents an item, and the final ranking is made over these.

Weights and scores are integers; a document's score is exact. Items are taken in blocks of bounded size,
read from the items' table one after the other, and every block meets all documents.

Defined results: null texts have no terms, as documents and as items; items that share an id are one item with all their
terms, a null id included; repeated rows are documents of their own; among equal scores the smaller doc_id
comes first, null last; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.frames import counted, id_and_text, map_batches
from evenkeel.llm.words import ALNUM, blocks, hash_words
from evenkeel.session import materialise

TOP = 10
#: UTF-8 bytes of item texts in one block of queries.
ITEM_BYTES = 4_000_000
#: Masks that are evaluated before the next look at the limit.
STRIDE = 64
SCALE = 1_000_000_000
FOUND = "doc_id bigint, n bigint, terms array<int>, times array<int>"


@dataclass
class Queries:
    """Sorted term hashes; per item its id and the places of its terms, rare ones not first."""

    terms: np.ndarray
    ids: list
    own: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    documents: int = 0
    length: int = 0

    def weigh(self, documents: int, length: int, frequency: np.ndarray) -> None:
        self.documents, self.length = documents, length
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in frequency], np.int64)


def make_queries(items: list[tuple]) -> Queries:
    """items: (id, text), several rows of one id next to each other."""
    words = hash_words([t for _, t in items], ALNUM)
    terms = np.unique(words.hashes)
    own: dict = {}
    for k, (item, _) in enumerate(items):
        own.setdefault(item, []).append(words.hashes[words.first[k] : words.first[k + 1]])
    places = [np.searchsorted(terms, np.unique(np.concatenate(x))) for x in own.values()]
    return Queries(terms, list(own), places)


def item_blocks(items: DataFrame, most: int = ITEM_BYTES) -> Iterator[list[tuple]]:
    """Rows (id, text) in blocks of about so many bytes; rows of one id stay together."""
    rows, size = [], 0
    for r in items.orderBy("item_id").toLocalIterator():
        if size > most and r[0] != rows[-1][0]:
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len((r[1] or "").encode("utf-8", "surrogatepass"))
    if rows:
        yield rows


def find_terms(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id, n (all terms), and the places of the document's query terms with their numbers of occurrences; documents without terms go."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def take(batches):
        known = sent.value
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for part in blocks(texts):
                w = hash_words(texts[part], ALNUM)
                n = np.diff(w.first)
                at = np.searchsorted(known, w.hashes)
                at[at == len(known)] = 0
                hit = known[at] == w.hashes if len(known) else np.zeros(len(at), bool)
                doc = np.repeat(np.arange(len(n)), n)[hit]
                keys, times = np.unique(doc * max(1, len(known)) + at[hit], return_counts=True)
                doc, term = np.divmod(keys, max(1, len(known)))
                kept = np.flatnonzero(n)
                offsets = pa.array(np.append(np.searchsorted(doc, kept), len(doc)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, times)]
                yield [ids.slice(part.start, part.stop - part.start).take(pa.array(kept)), pa.array(n[kept]), *lists]

    return map_batches(docs, take, FOUND)


class _Block:
    """The postings of one batch by term, with each term's share of a document's score before its weight."""

    def __init__(self, b: pa.RecordBatch, q: Queries):
        size = np.diff(b.column(2).offsets.to_numpy())
        self.docs = b.num_rows
        term = b.column(2).flatten().to_numpy().astype(np.int64)
        tf = b.column(3).flatten().to_numpy().astype(np.int64)
        n = b.column(1).to_numpy()
        doc = np.repeat(np.arange(self.docs), size)
        m = 10 + 90 * n * q.documents // q.length
        order = np.argsort(term, kind="stable")
        term, self.doc, tf = term[order], doc[order], tf[order]
        self.share = SCALE * tf // (1000 * tf + 8 * m[self.doc])
        self.first = np.searchsorted(term, np.arange(len(q.terms) + 1))
        #: A null id is ranked behind all others.
        ids = b.column(0)
        self.blank = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()

    def bitmap(self, term: int) -> np.ndarray:
        """One bit for each document of the block."""
        bits = np.zeros(self.docs, bool)
        bits[self.doc[self.first[term] : self.first[term + 1]]] = True
        return np.packbits(bits)

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct non-empty masks (a row of bits each), the documents by mask, and where each mask's documents begin."""
        rows = np.unpackbits(np.stack([self.bitmap(t) for t in terms]), axis=1, count=self.docs)
        packed = np.packbits(rows, axis=0).T
        key = np.ascontiguousarray(packed).view(f"V{packed.shape[1]}").ravel() if packed.shape[1] > 8 else _as_number(packed)
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        masks = np.unpackbits(packed[order[heads]], axis=1, count=len(terms))
        firsts = np.append(heads, len(order))
        if not masks[0].any():
            masks, firsts = masks[1:], firsts[1:]
        return masks, order, firsts

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The documents' exact scores."""
        total, at = np.zeros(len(docs), np.int64), np.full(self.docs, -1)
        at[docs] = np.arange(len(docs))
        for t, w in zip(terms, weights):
            own = slice(self.first[t], self.first[t + 1])
            place = at[self.doc[own]]
            total[place[place >= 0]] += w * self.share[own][place >= 0]
        return total


def _as_number(packed: np.ndarray) -> np.ndarray:
    """Up to eight bytes a row as one number."""
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64).ravel()


def _best(found: list[tuple], top: int) -> list[tuple]:
    """The first rows (-score, id is null, id)."""
    return sorted(found)[:top]


def search_block(block: _Block, q: Queries, best: list[list[tuple]], top: int) -> int:
    """Bring each item's best documents up to date with a block; returns how many documents were scored."""
    scored = 0
    most = np.zeros(len(q.terms), np.int64)
    there = np.flatnonzero(np.diff(block.first))
    if len(there):
        most[there] = np.maximum.reduceat(block.share, block.first[there])
    for k, own in enumerate(q.own):
        terms = own[(most[own] > 0) & (q.weights[own] > 0)]
        if not len(terms):
            continue
        masks, order, firsts = block.masks(terms)
        weights = q.weights[terms]
        highest = masks.astype(np.int64) @ (weights * most[terms])
        turn = np.argsort(-highest, kind="stable")
        for begin in range(0, len(turn), STRIDE):
            now = turn[begin : begin + STRIDE]
            if len(best[k]) == top:
                # A mask that can only equal the last place may still bring a smaller id.
                now = now[highest[now] >= -best[k][-1][0]]
                if not len(now):
                    break
            docs = np.concatenate([order[firsts[g] : firsts[g + 1]] for g in now])
            score = block.scores(docs, terms, weights)
            scored += len(docs)
            if len(best[k]) == top:
                docs, score = docs[score >= -best[k][-1][0]], score[score >= -best[k][-1][0]]
            if len(docs) > top:
                # Only those that reach the top among themselves; all ties with the last are looked at by id.
                cut = np.partition(score, len(score) - top)[len(score) - top]
                docs, score = docs[score >= cut], score[score >= cut]
                if len(docs) > 4 * top:
                    first = np.lexsort((block.ids[docs], block.blank[docs], -score))[:top]
                    docs, score = docs[first], score[first]
            rows = zip((-score).tolist(), block.blank[docs].tolist(), block.ids[docs].tolist())
            best[k] = _best(best[k] + [r for r in rows if r[0] < 0], top)
    return scored


def _ranked(found: DataFrame, q: Queries, top: int) -> DataFrame:
    """place of the item, doc_id, score: the first documents of every item in each task."""
    sent = found.sparkSession.sparkContext.broadcast(q)

    def take(batches):
        own, best = sent.value, [[] for _ in sent.value.ids]
        for b in batches:
            if b.num_rows:
                search_block(_Block(b, own), own, best, top)
        rows = [(k, None if r[1] else r[2], -r[0]) for k, x in enumerate(best) for r in x]
        if rows:
            yield [list(x) for x in zip(*rows)]

    return map_batches(found, take, "item int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents of all, scores above 0 only."""
    docs, items = id_and_text(docs), items.select("item_id", F.col("text").cast("string").alias("text"))
    spark, kind, out = docs.sparkSession, items.schema["item_id"].dataType.simpleString(), None
    for rows in item_blocks(items):
        q = make_queries(rows)
        found = materialise(find_terms(docs, q.terms), "found_terms")
        total = found.agg(F.count("*"), F.sum("n")).first()
        if not total[0] or not len(q.terms):
            continue
        q.weigh(total[0], total[1], counted(found.select("terms"), lambda b: iter([b.column(0).flatten().to_numpy()]), len(q.terms)))
        first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = _ranked(found, q, top).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, x) for k, x in enumerate(q.ids)], f"item int, item_id {kind}")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        best = materialise(best, "ranked")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
