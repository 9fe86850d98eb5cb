"""Phrase collocations by dynamic itemset counting.

The texts are dealt over shards that are scanned in turn, again and again. Words are counted from the first scan on. A longer phrase is activated
at the first scan after both of its subphrases, without its last and without its first word, have reached the threshold,
and is counted for one full cycle of the shards, so phrases of all lengths are counted side by side.
The scans end when every activated phrase has had its cycle.

A task knows the phrases that have reached the threshold by a filter of bounded size: each of its cells holds, as bits, the scans after which a phrase
of that cell was there. A phrase of two colliding cells may be counted with a start that isn't its own; counts are kept by phrase and start,
and at the end the start that follows from the exact table of subphrases is the one that holds. So the filter costs work at
worst and changes no result. What is shuffled are (hash, start and length, count) rows, summed up before in every task.

A last scan reads the words' texts, the subphrases of the frequent phrases, and the numbers of words. Counts of first and last parts
are handed on from subphrases to phrases by joins of frequent phrases only.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each; a language without
candidates has no rows; an empty table gives an empty result; other columns play no part. Phrases are told apart by 64-bit hashes of language and words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.frames import map_batches
from evenkeel.llm.words import blocks, hash_runs, mixed
from evenkeel.session import materialise, remove, scratch_path, small_batches

SHARDS = 2
LONGEST = 4
LEAST = 30
#: A candidate goes if a longer one around it is at least so frequent, in hundredths.
CONTAINED = 80
TOP = 2000
#: The filter has 2 ** bits cells, eight at least for a phrase in it, up to the larger bound.
FEWEST_BITS, MOST_BITS = 16, 25
BLOCK_BYTES = 4_000_000
#: Slices in which the first phrases are looked for before they are ranked.
SLICES = 256

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BREAK, _SPACE = 10, 32
_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
for _b in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_b] = _BREAK
_TABLE[9] = _SPACE
_TABLE = bytes(_TABLE)


def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Block:
    """The words of some texts: hashes that depend on the language, pieces, and where they stand."""

    def __init__(self, langs: list[str], texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.bytes = b"\n".join(raw).translate(_TABLE) + b"\n" * 9
        data = np.frombuffer(self.bytes, np.uint8)
        ends = data == _BREAK
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ~ends & (data != _SPACE)]).view(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        begins = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
        self.doc = np.searchsorted(begins, self.starts, "right") - 1
        self.langs = langs
        own = np.array([_language(x) for x in langs], np.uint64)
        self.words = mixed(hash_runs(data, self.starts, self.ends) * _ODD + own[self.doc]) if len(self.starts) else np.zeros(0, np.uint64)
        self.piece = np.cumsum(ends, dtype=np.int32)[self.starts]

    def word(self, k: int) -> str:
        return self.bytes[self.starts[k] : self.ends[k]].decode("utf-8", "surrogatepass")


def _blocks(batches):
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for part in blocks(texts, BLOCK_BYTES):
            yield _Block(langs[part], texts[part])


def _levels(block: _Block, cells: np.ndarray, bits: int, longest: int):
    """(length, places, hashes, prefixes, suffixes, cells of both) of the phrases whose subphrases are both in the filter."""
    shift = np.uint64(64 - bits)
    h = block.words
    c = cells[h >> shift]
    for k in range(2, longest + 1):
        if len(h) < 2:
            return
        live = np.flatnonzero((block.piece[k - 1 :] == block.piece[: len(block.piece) - k + 1]) & (c[:-1] != 0) & (c[1:] != 0))
        pre, suf = h[live], h[live + 1]
        own = mixed(pre * _ODD + suf)
        yield k, live, own, pre, suf, c[live], c[live + 1]
        h, c = np.zeros(len(h) - 1, np.uint64), np.zeros(len(h) - 1, cells.dtype)
        h[live], c[live] = own, cells[own >> shift]


def _scan(texts: DataFrame, step: int, shards: int, cells: np.ndarray, bits: int, longest: int) -> DataFrame:
    """(hash, tag, n) of the phrases that are active in a step; the tag holds start and length."""
    sent = texts.sparkSession.sparkContext.broadcast(cells)
    starts = range(max(1, step - shards + 1), step + 1)

    def rows(hashes, start, k):
        h, n = np.unique(hashes, return_counts=True)
        return [h.view(np.int64), np.full(len(h), start * 8 + k, np.int32), n]

    def take(batches):
        known = sent.value
        window = known.dtype.type(sum(1 << r for r in starts if r <= (longest - 1) * shards))
        for block in _blocks(batches):
            if step < shards and len(block.words):
                yield rows(block.words, 0, 1)
            for k, _, h, _, _, a, b in _levels(block, known, bits, longest):
                due = np.flatnonzero((a | b) & window)
                h, a, b = h[due], a[due], b[due]
                for r in starts:
                    # Words end with the first cycle, so a phrase of k words starts in the first k - 1 cycles or right after them.
                    if r > (k - 1) * shards:
                        continue
                    one, upto = known.dtype.type(1 << r), known.dtype.type((2 << r) - 1)
                    mine = ((a & one) != 0) & ((b & upto) != 0) | ((b & one) != 0) & ((a & upto) != 0)
                    if mine.any():
                        yield rows(h[mine], r, k)

    return map_batches(texts, take, "h bigint, tag int, n bigint")


def _filter(reached: DataFrame | None, size: int, shards: int, longest: int) -> tuple[np.ndarray, int]:
    """Cells with the steps of the phrases in them as bits, and their number as a power of two."""
    last = (longest - 1) * shards
    kind = np.uint16 if last < 16 else np.uint32 if last < 32 else np.uint64
    bits = min(MOST_BITS, max(FEWEST_BITS, (8 * size).bit_length()))
    cells = np.zeros(1 << bits, kind)
    if reached is not None and size:
        of = reached.select(F.shiftrightunsigned("h", 64 - bits).alias("cell"), F.expr("shiftleft(1L, reach)").alias("b"))
        # At most a row for each cell reaches the driver, in batches.
        table = of.groupBy("cell").agg(F.bit_or("b").alias("b")).toArrow()
        cells[table.column("cell").to_numpy()] = table.column("b").to_numpy().astype(kind)
    return cells, bits


def frequent(texts: DataFrame, shards: int, least: int, longest: int) -> DataFrame:
    """(h, len, start, a, reach) of all phrases that are counted at least so often, some of them with starts that aren't theirs.

    texts: lang, text and the column shard, by which the table is partitioned.
    """
    spark, step, last, active, done, cells, bits = texts.sparkSession, 0, 0, None, [], *_filter(None, 0, shards, longest)
    old = None
    while step < last + shards:
        found = _scan(texts.where(F.col("shard") == step % shards).select("lang", "text"), step, shards, cells, bits, longest)
        found = found.withColumn("reach", F.lit(None).cast("int"))
        both = found if active is None else active.unionByName(found)
        sums = both.groupBy("h", "tag").agg(F.sum("n").alias("n"), F.min("reach").alias("reach"))
        sums = sums.withColumns({
            "reach": F.coalesce("reach", F.when(F.col("n") >= least, step + 1)),
            "ended": F.expr("tag div 8") == step - shards + 1,
        }).where(~F.col("ended") | (F.col("n") >= least))
        path = scratch_path(spark, "phrases")
        sums.write.partitionBy("ended").parquet(path)
        if old:
            remove(spark, f"{old}/ended=false")
        now = spark.read.schema(sums.schema).parquet(path)
        active, old = now.where("not ended").drop("ended"), path
        done.append(now.where("ended").drop("ended"))
        # Phrases of full length have no successors.
        reached = _union([*done, active]).where(f"reach is not null and tag % 8 < {longest}")
        size, top = reached.agg(F.count("*"), F.max("reach")).first()
        last, step = max(last, top or 0), step + 1
        cells, bits = _filter(reached, size, shards, longest)
    out = _union(done).select("h", F.expr("tag % 8").alias("len"), F.expr("cast(tag div 8 as int)").alias("start"), F.col("n").alias("a"), "reach")
    return materialise(out, "frequent")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _spelled(texts: DataFrame, found: DataFrame, shards: int, longest: int) -> DataFrame:
    """(len, h, pre, suf, lang, word, n): subphrases of the frequent phrases, language and text of the words; with len 0 the languages' numbers of words.

    Shard by shard: a phrase that one shard has spelled isn't handed out again by the next.
    """
    done: list[DataFrame] = []
    for s in range(shards):
        wanted = found if not done else found.join(_union(done).where("len > 0").select("h"), "h", "left_anti")
        done.append(materialise(_spelled_in(texts.where(F.col("shard") == s), found, wanted, longest), "spelled"))
    return _union(done)


def _spelled_in(texts: DataFrame, found: DataFrame, wanted: DataFrame, longest: int) -> DataFrame:
    # Bit 1: frequent, so that longer phrases are followed up; bit 2: to be spelled.
    known = found.select("h", F.lit(1).alias("reach")).unionByName(wanted.select("h", F.lit(2).alias("reach")))
    cells, bits = _filter(known, found.count(), 1, longest)
    sent = texts.sparkSession.sparkContext.broadcast(cells)

    def take(batches):
        cells = sent.value
        due = cells.dtype.type(4)
        shift, seen, totals = np.uint64(64 - bits), np.zeros(0, np.uint64), {}

        def new(hashes):
            nonlocal seen
            hashes, at = np.unique(hashes, return_index=True)
            fresh = np.isin(hashes, seen, assume_unique=True, invert=True)
            seen = np.concatenate([seen, hashes[fresh]])
            return at[fresh]

        for block in _blocks(batches):
            for d, n in enumerate(np.bincount(block.doc, minlength=len(block.langs)).tolist()):
                totals[block.langs[d]] = totals.get(block.langs[d], 0) + n
            at = np.flatnonzero(cells[block.words >> shift] & due)
            at = at[new(block.words[at])]
            if len(at):
                h, none = block.words[at].view(np.int64), pa.nulls(len(at), pa.int64())
                yield [np.ones(len(at), np.int32), h, none, none, [block.langs[d] for d in block.doc[at]], [block.word(k) for k in at], none]
            for k, _, h, pre, suf, _, _ in _levels(block, cells, bits, longest):
                at = np.flatnonzero(cells[h >> shift] & due)
                at = at[new(h[at])]
                if len(at):
                    blank = pa.nulls(len(at), pa.string())
                    yield [np.full(len(at), k, np.int32), *(x[at].view(np.int64) for x in (h, pre, suf)), blank, blank, pa.nulls(len(at), pa.int64())]
        if totals:
            none, blank = pa.nulls(len(totals), pa.int64()), pa.nulls(len(totals), pa.string())
            yield [np.zeros(len(totals), np.int32), none, none, none, list(totals), blank, list(totals.values())]

    rows = map_batches(texts.select("lang", "text"), take, "len int, h bigint, pre bigint, suf bigint, lang string, word string, n bigint")
    keys = ["len", "h", "pre", "suf", "lang", "word"]
    rows = materialise(rows.groupBy(*keys).agg(F.sum("n").alias("n")), "met")
    # The filter also lets phrases of the same cells through, some of which an earlier shard has spelled.
    return rows.where("len = 0").unionByName(rows.where("len > 0").join(wanted.select("h"), "h", "left_semi").select(rows.columns))


def _grown(found: DataFrame, spelled: DataFrame, longest: int) -> list[DataFrame]:
    """For each length the frequent phrases: lang, phrase, its last word, pre, suf, a, reach, counts of first parts (heads) and of last parts (tails) by length."""
    one = found.where("len = 1").join(spelled.where("len = 1").select("h", "lang", "word"), "h")
    each = F.array("a")
    one = one.select("h", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), *[F.lit(None).cast("long").alias(x) for x in ("pre", "suf")],
                     "a", "reach", each.alias("heads"), each.alias("tails"))
    out = [materialise(one, "words")]
    for k in range(2, longest + 1):
        less = out[-1]
        own = found.where(F.col("len") == k).join(spelled.where(F.col("len") == k).select("h", "pre", "suf"), "h")
        own = own.join(less.select(F.col("h").alias("pre"), "lang", F.col("phrase").alias("front"), F.col("reach").alias("one"), "heads"), "pre")
        own = own.join(less.select(F.col("h").alias("suf"), "last", F.col("reach").alias("two"), "tails"), "suf")
        # Only this start is that of the exact subphrases.
        own = own.where(F.col("start") == F.greatest("one", "two"))
        out.append(materialise(own.select(
            "h", "lang", F.concat_ws(" ", "front", "last").alias("phrase"), "last", "pre", "suf", "a", "reach",
            F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"),
        ), "phrases"))
    return out


def _first(df: DataFrame, by: list, top: int) -> DataFrame:
    """The first rows of each language, with rank: in slices at first, so that no task sorts a whole language."""
    part = Window.partitionBy("lang", "slice").orderBy(*by)
    df = df.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    df = df.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank", "slice")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("bigint")).where(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, contained: int = CONTAINED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two words and more.

    a counts the phrase; l and r count its two parts at the cut with the lowest score, floor(2000000 a / (l + r)); n counts the language's words.
    """
    with small_batches(docs.sparkSession):
        return _mined(docs, least, longest, top, shards, contained)


def _mined(docs: DataFrame, least: int, longest: int, top: int, shards: int, contained: int) -> DataFrame:
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").alias("__id"))
    read = read.where("text is not null").withColumn("shard", F.pmod(F.xxhash64("__id", "text"), F.lit(shards)).cast("int"))
    path = scratch_path(spark, "shards")
    read.drop("__id").write.partitionBy("shard").parquet(path)
    texts = spark.read.schema("lang string, text string, shard int").parquet(path)
    found = frequent(texts, shards, least, longest)
    spelled = _spelled(texts, found, shards, longest)
    remove(spark, path)
    grown = _grown(found, spelled, longest)
    out = []
    for k in range(2, longest + 1):
        own = grown[k - 1]
        if k < longest:
            around = grown[k].select(F.explode(F.array("pre", "suf")).alias("h"), F.col("a").alias("around")).groupBy("h").agg(F.max("around").alias("around"))
            own = own.join(around, "h", "left").where(f"around is null or 100 * cast(around as decimal(20)) < {contained} * cast(a as decimal(20))")
        cuts = [f"struct((cast(a as decimal(20)) * 2000000) div cast(heads[{j - 1}] + tails[{k - j - 1}] as decimal(20)) as score, {j} as cut, heads[{j - 1}] as l, tails[{k - j - 1}] as r)" for j in range(1, k)]
        out.append(own.withColumn("best", F.expr(f"array_min(array({', '.join(cuts)}))")).select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    totals = spelled.where("len = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = materialise(_first(_union(out), by, top), "ranked")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
