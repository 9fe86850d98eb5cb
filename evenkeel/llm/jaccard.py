"""Near duplicates by an n-gram Jaccard join with rare-first prefix filtering.

A document's set is its distinct word shingles. Equal sets are one class, so copies cost one row each.
Shingles are ordered from rare to frequent by a bounded frequency sketch of the whole corpus (ties by
hash); any common order keeps the join exact, a good one keeps it small. Two classes can only be
similar enough if they share a shingle within their prefixes, if their sizes are close (length filter), if the
shared places leave room for enough others (positional filter), and if few enough of many ranges of hashes hold an odd
number of one's shingles and an even number of the other's (suffix filter). Of the smaller set a shorter prefix is enough. Candidates are verified once per pair against the whole sets.

Sets are never written or shuffled: they take more room than the texts that they come from. Each step works them out from the
texts that it needs, so the texts are read several times and must be the same each time.

Large groups of near copies aren't expanded into all pairs. First the members of a large group that shares a shingle
are tried against leaders, members of the group's largest component so far. Pairs that are connected by then
can't change a component; when leaders settle little more, all that are left are tried. So no component is lost,
and a group of m copies costs about m comparisons.

Defined results: null and empty texts have empty sets and are linked with nothing; rows without an id
link others but have no component of their own name; repeated rows are copies; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.frames import counted, counted_over, id_and_text, map_batches
from evenkeel.llm.graph import components
from evenkeel.llm.words import SPACED, blocks, hash_words, mixed, shingles
from evenkeel.session import remove, scratch_path, small_batches

WORDS = 5
PERCENT = 80
#: Cells of the frequency sketch: one for so many shingles of the corpus, within these bounds.
SHINGLES_A_CELL = 256
SKETCH = (1 << 18, 1 << 22)
#: Cells of the filter for the ids whose texts are read: eight for each, two of them marked, within these bounds.
FILTER = (1 << 19, 1 << 27)
#: Shingles that a task works on at once.
AT_ONCE = 250_000
#: Ranges of hashes of the suffix filter, 64 to a number.
RANGES = 1024
#: A shingle that the sketch takes for more frequent than this has its postings spread over several leaders.
LEADER_ROWS = 20_000
#: Leaders that are tried at once.
LEADERS = 12
#: Groups of so many classes of like size are expanded into pairs without leaders: that is bounded work for each posting.
SMALL = 8
#: A class that is compared with more others than this has its set sent to several tasks.
COMPARED = 512


class _Tables:
    """Tables of one run in the shared folder. One that is written under an earlier name takes that one's place."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for path in filter(None, (self.paths.pop(n, None) for n in names)):
            remove(self.spark, path)


def _cells_for(n: int, bounds: tuple[int, int]) -> int:
    """The power of two from n on, within the bounds."""
    return min(max(1 << max(n - 1, 0).bit_length(), bounds[0]), bounds[1])


def _each(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The set of each text, worked out by blocks of texts."""
    for part in blocks(texts):
        w = hash_words(texts[part], SPACED)
        for i in range(len(w.first) - 1):
            yield shingles(w.hashes[w.first[i] : w.first[i + 1]], width)


def _class(s: np.ndarray) -> int:
    """A set's class: 64 bits of a hash of all its members."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _stored_sets(docs: DataFrame, width: int) -> DataFrame:
    """What is stored of each document's set: id, class, set size, and ranges of hashes with odd numbers of shingles. Empty sets have no class."""

    def take(batches):
        for b in batches:
            sets = _each(b.column(1).to_pylist(), width)
            rows = [(_class(s), len(s), _odd_ranges(s)) if len(s) else (None, 0, None) for s in sets]
            if rows:
                yield [b.column(0), *[list(x) for x in zip(*rows)]]

    return map_batches(docs, take, "doc_id bigint, class bigint, size int, ranges array<bigint>")


def _distinct(batches, width: int) -> Iterator[list[tuple]]:
    """(class, set) of the texts, in lists of about so many shingles; a class comes once from a task."""
    seen = set()

    def new():
        for b in batches:
            for s in _each(b.column(1).to_pylist(), width):
                c = _class(s) if len(s) else None
                if c is not None and c not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    yield c, s

    return _by_size(new())


def _odd_ranges(s: np.ndarray) -> list[int]:
    """A bit for each range of hashes: whether it holds an odd number of the set's shingles."""
    counts = np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=RANGES)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64).tolist()


def _by_size(sets: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Tuples that end in a set, in lists of about so many shingles; a larger set stands alone."""
    some, size = [], 0
    for row in sets:
        if some and size + len(row[-1]) > AT_ONCE:
            yield some
            some, size = [], 0
        some.append(row)
        size += len(row[-1])
    if some:
        yield some


def _cells(s: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two cells of a sketch of so many for each shingle."""
    m = mixed(s)
    return (m >> np.uint64(40)).astype(np.int64) % size, (m & np.uint64(size - 1)).astype(np.int64) + size


def _frequencies(docs: DataFrame, width: int, size: int) -> np.ndarray:
    def cells(batches):
        for some in _distinct(batches, width):
            yield np.concatenate(_cells(np.concatenate([s for _, s in some]), size))

    return counted_over(docs, cells, 2 * size)


def least_overlap(a: int, b: int, percent: int) -> int:
    """The smallest intersection of sets of these sizes that reaches the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def index_length(n, percent: int):
    """Shingles of the smaller of two sets of which one must lie in the larger one's prefix; n is a number or an array."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _postings(docs: DataFrame, width: int, sketch: np.ndarray, percent: int) -> DataFrame:
    """A row per shingle of each class's prefix: shingle, part, parts, class, size, place."""
    size = len(sketch) // 2
    # What any cell holds by chance doesn't make a shingle frequent.
    sent = docs.sparkSession.sparkContext.broadcast((sketch, 2 * int(sketch.sum()) // len(sketch)))

    def take(batches):
        counts, chance = sent.value
        for some in _distinct(batches, width):
            rows = []
            for c, s in some:
                one, two = _cells(s, size)
                often = np.minimum(counts[one], counts[two])
                order = np.lexsort((s, often))[: prefix_length(len(s), percent)]
                parts = 1 + np.maximum(often[order] - chance, 0) // LEADER_ROWS
                n = len(order)
                rows.append((s[order].view(np.int64), c % parts, parts, np.full(n, c), np.full(n, len(s)), np.arange(n)))
            yield [pa.array(np.concatenate(x)) for x in zip(*rows)]

    return map_batches(docs, take, "shingle bigint, part int, parts int, class bigint, size int, place int")


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of shingles that several classes have in their prefixes; others lead to no pair.

    One shuffle: a class always lies in the same part of a shingle, so its repeats meet there too. Shingles that the
    sketch takes for frequent are spread over their parts and kept without counting.
    """
    key = Window.partitionBy("shingle", "part")
    one = F.min("class").over(key) == F.max("class").over(key)
    shared = postings.repartition("shingle", "part").withColumn("one", one).where("parts > 1 or not one")
    return shared.drop("one").dropDuplicates(["shingle", "part", "class"])


def _allowed(percent: int, shared: str):
    """Whether so many shared shingles reach the similarity of sets of sizes na and nb."""
    return F.expr(f"100L * ({shared}) >= {percent}L * (cast(na as bigint) + nb - ({shared}))")


def _suffix(percent: int, ra: str = "ra[{}]", rb: str = "rb[{}]"):
    """Suffix filter: ranges in which one set's number is odd and the other's is even hold a shingle each that isn't shared."""
    apart = " + ".join(f"bit_count({ra.format(i)} ^ {rb.format(i)})" for i in range(RANGES // 64))
    return F.expr(f"{100 + percent} * ({apart}) <= {100 - percent}L * (cast(na as bigint) + nb)")


def _filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that pass the suffix filter."""
    c = classes.select("class", "ranges")
    pairs = pairs.select("a", "b", "na", "nb").distinct()
    pairs = pairs.join(c.select(F.col("class").alias("a"), F.col("ranges").alias("ra")), "a")
    pairs = pairs.join(c.select(F.col("class").alias("b"), F.col("ranges").alias("rb")), "b")
    return pairs.where(_suffix(percent)).select("a", "b", "na", "nb")


def _id_cells(ids: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two cells of a filter of so many for each id; one that is missing counts as 0."""
    m = mixed(np.asarray(ids.fill_null(0)).view(np.uint64))
    return (m >> np.uint64(32)).astype(np.int64) % size, (m & np.uint64(size - 1)).astype(np.int64)


def _texts_of(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(class, text) of the classes of the pairs, once each, and of a few more: a filter of bounded size for the least id of
    each class is put to the documents before any text is split."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes.select("class", "first"), "class")
    ends = ends.select("first")
    size = _cells_for(8 * ends.count(), FILTER)
    wanted = counted(ends, lambda b: iter(_id_cells(b.column(0), size)), size) > 0
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def take(batches):
        bits, seen = np.unpackbits(sent.value).view(bool), set()
        for b in batches:
            one, two = _id_cells(b.column(0), size)
            b = b.filter(pa.array(bits[one] & bits[two]))
            texts, rows = b.column(1).to_pylist(), []
            for s, t in zip(_each(texts, width), texts):
                c = _class(s) if len(s) else None
                if c is not None and c not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    rows.append((c, t))
            if rows:
                yield [list(x) for x in zip(*rows)]

    return map_batches(docs, take, "class bigint, text string").groupBy("class").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. The text of a class b that is compared often goes to several tasks;
    the others' stay where they are and the texts of a come to them."""
    own = _texts_of(pairs, docs, classes, width)
    often = pairs.groupBy("b").agg(F.expr(f"count(*) div {COMPARED}").cast("int").alias("more")).where("more > 0")
    first, second = (own.select(F.col("class").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    spread = not often.isEmpty()
    both = pairs.join(often, "b", "left_anti") if spread else pairs
    both = both.join(first, "a").join(second, "b").select("a", "b", "ta", "tb")
    if spread:
        dealt = pairs.join(often, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("more") + 1).cast("int")).join(first, "a")
        copies = second.join(often, "b").select("b", "tb", F.explode(F.sequence(F.lit(0), "more")).alias("copy"))
        both = both.unionByName(dealt.join(copies, ["b", "copy"]).select("a", "b", "ta", "tb"))

    def similar(batches):
        last, y = None, None
        for b in batches:
            # Rows come by b, so its set is worked out once for a run of them.
            ends, found = b.column(1).to_pylist(), []
            new = [x != before for x, before in zip(ends, [last, *ends])]
            others = _each(b.column(3).filter(pa.array(new, pa.bool_())).to_pylist(), width)
            for x, fresh in zip(_each(b.column(2).to_pylist(), width), new):
                y = next(others) if fresh else y
                # Both are sorted and without repeats.
                few, many = sorted((x, y), key=len)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                n = int((many[at] == few).sum())
                found.append(100 * n >= percent * (len(x) + len(y) - n))
            last = ends[-1] if ends else last
            yield b.select([0, 1]).filter(pa.array(found, pa.bool_())).columns

    return map_batches(both, similar, "a bigint, b bigint")


def _fits(percent: int):
    """Length and positional filters on two postings of a shingle: na, nb sizes; pa, pb places."""
    return F.expr(f"100L * least(na, nb) >= {percent}L * greatest(na, nb)") & _allowed(percent, "least(na - pa, nb - pb)")


def _leader_pairs(postings: DataFrame, seeds: list[int], percent: int) -> DataFrame:
    """Postings against leaders of their shingles: for each seed one member of the shingle's largest component.

    Frequent shingles have leaders part by part, and the parts' leaders are tried against the shingle's. A class
    keeps one leader for each seed: that with which it shares most.
    """
    ranks = [f"min(struct(-weight as w, xxhash64(class, {seed}) as r, class, size, place, root))" for seed in seeds]
    parts = postings.groupBy("shingle", "part").agg(F.expr(f"array({', '.join(ranks)})").alias("l"))
    tops = parts.groupBy("shingle").agg(F.expr(f"array({', '.join(f'min(l[{i}])' for i in range(len(seeds)))})").alias("l"))

    def against(rows, leaders, keys, seeded):
        left = rows.select(*keys, *seeded, F.col("class").alias("a"), F.col("size").alias("na"), F.col("place").alias("pa"), F.col("root").alias("ra"))
        both = left.join(leaders.select(*keys, "l"), keys)
        both = both.select("a", "na", "pa", "ra", *seeded, F.posexplode("l").alias("seed", "m"))
        if seeded:
            both = both.where("own = seed")
        both = both.select("seed", "a", "na", "pa", "ra", *[F.expr(f"m.{x} as {y}") for x, y in (("class", "b"), ("size", "nb"), ("place", "pb"), ("root", "rb"))])
        return both.where("ra <> rb").where(_fits(percent)).select("seed", "a", "b", "na", "nb")

    pairs = against(postings, parts, ["shingle", "part"], [])
    heads = parts.where("part > 0").select("shingle", F.posexplode("l").alias("own", "m")).select("shingle", "own", "m.*")
    pairs = pairs.unionByName(against(heads, tops, ["shingle"], ["own"]))
    counts = pairs.groupBy("seed", "a", "b", "na", "nb").agg(F.count("*").alias("n"))
    best = counts.groupBy("seed", "a").agg(F.max(F.struct("n", "b", "na", "nb")).alias("m"))
    return best.select("a", "m.b", "m.na", "m.nb")


def _all_pairs(postings: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All pairs of prefix groups whose classes are in different components: the smaller set's index prefix against the larger's whole prefix.

    The smaller sets of a frequent shingle lie in its parts, and the larger ones are sent to each of them. In large
    groups the suffix filter is part of the join.
    """

    def joined(rows, more=()):
        left = rows.where(F.col("place") < index_length_of(percent)).select("shingle", "part", *_side("a", more))
        right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("shingle", "part", *_side("b", more))
        both = left.join(right, ["shingle", "part"]).where("root_a <> root_b and (na, a) < (nb, b)").where(_fits(percent))
        return (both.where(_suffix(percent, "ra{}", "rb{}")) if more else both).select("a", "b", "na", "nb")

    large = postings.where("large").join(classes.select("class", "ranges"), "class")
    return joined(large, range(RANGES // 64)).unionByName(joined(postings.where("not large")))


def _side(side: str, more) -> list:
    named = {"class": side, "size": f"n{side}", "place": f"p{side}", "root": f"root_{side}"}
    return [F.col(x).alias(y) for x, y in named.items()] + [F.col("ranges")[i].alias(f"r{side}{i}") for i in more]


def index_length_of(percent: int):
    """``index_length`` of the column size."""
    return F.expr(f"size - ((2L * {percent} * size + {99 + percent}) div {100 + percent}) + 1")


def _rooted(postings: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The postings with the root and the size of their class's component so far."""
    if roots is None:
        return postings.withColumns({"root": F.col("class"), "weight": F.lit(1).cast("long")})
    weights = roots.groupBy("root").agg(F.count("*").alias("weight"))
    named = roots.join(weights, "root").withColumnRenamed("node", "class")
    rooted = postings.drop("root", "weight").join(named, "class", "left")
    return rooted.withColumns({"root": F.coalesce("root", "class"), "weight": F.coalesce("weight", F.lit(1).cast("long"))})


def _unsettled(postings: DataFrame, roots: DataFrame | None, tables: _Tables, name: str) -> tuple[DataFrame, int]:
    """The postings of shingles whose classes lie in several components, with large: whether their shingle's group is; and the
    number of pairs of like sizes and different components that there are in large groups."""
    rooted = _rooted(postings, roots).drop("large")
    lo, hi = F.min("root").alias("lo"), F.max("root").alias("hi")
    # Sizes in steps of a quarter: pairs of other steps mostly fail the length filter.
    step = F.floor(F.log("size") / F.log(F.lit(1.25))).alias("step")
    if roots is None:
        # Every class is a component of its own, and a shingle has one row of it.
        each = rooted.groupBy("shingle", step).agg(F.count("*").alias("n"), lo, hi)
        twice = f"case when n > {SMALL} then n * n - n else 0L end as twice"
        each = each.select("shingle", F.expr(twice), "lo", "hi")
    else:
        each = rooted.groupBy("shingle", step, "root").agg(F.count("*").alias("n"))
        twice = F.expr(f"case when sum(n) > {SMALL} then sum(n) * sum(n) - sum(n * n) else 0 end").alias("twice")
        each = each.groupBy("shingle", "step").agg(twice, lo, hi)
    keys = each.groupBy("shingle").agg(F.sum("twice").alias("twice"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    keys = tables.keep(keys.drop("lo", "hi"), "keys")
    rest = tables.keep(rooted.join(keys.select("shingle", F.expr("twice > 0").alias("large")), "shingle"), name)
    return rest, (keys.agg(F.sum("twice")).first()[0] or 0) // 2


def _resolved(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members; classes with the least id of each (first); and for linked classes the component's root and least id."""
    with small_batches(docs.sparkSession):
        return _resolved_in(docs, width, percent)


def _resolved_in(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, tables = id_and_text(docs), _Tables(docs.sparkSession)
    members = tables.keep(_stored_sets(docs, width), "members")
    classes = members.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("ranges").alias("ranges")
    )
    classes = tables.keep(classes, "classes")
    total = classes.agg(F.sum("size")).first()[0] or 0
    sketch = _frequencies(docs, width, _cells_for(total // SHINGLES_A_CELL, SKETCH))
    rest = tables.keep(_shared(_postings(docs, width, sketch, percent)), "postings")
    rest, n = _unsettled(rest, None, tables, "first-unsettled")
    tables.drop("postings")
    # Small groups wait for the end; only large ones go through the rounds.
    small, rest = rest.where("not large"), rest.where("large")
    roots, before, step = None, None, 0
    while True:
        # All pairs once no large group is left, or once leaders settle little.
        last = n == 0 or (before is not None and 10 * n > 9 * before)
        if last:
            pairs = _all_pairs(rest.unionByName(_rooted(small, roots)), classes, percent)
        else:
            pairs = _leader_pairs(rest.where("large"), list(range(LEADERS * step, LEADERS * (step + 1))), percent)
        pairs = tables.keep(_filtered(pairs, classes, percent), "candidates")
        links = tables.keep(_verified(pairs, docs, classes, width, percent), "verified")
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = tables.keep(components(links), "roots")
        if last:
            break
        before, step = n, step + 1
        rest, n = _unsettled(rest, roots, tables, "unsettled")
    named = roots.join(classes.select(F.col("class").alias("node"), "first"), "node")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    tables.drop("keys", "first-unsettled", "unsettled", "candidates", "verified")
    return members, classes, named.join(least, "root").select(F.col("node").alias("class"), "root", "least")


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    component_id is the smallest id among the documents that links of the given similarity lead to.
    """
    members, classes, named = _resolved(docs, width, percent)
    out = members.join(classes.select("class", "first"), "class", "left").join(named.drop("root"), "class", "left")
    return out.select(
        "doc_id", F.col("size").cast("bigint").alias("n_shingles"), F.coalesce("least", "first", "doc_id").alias("component_id")
    )


def _with_class(docs: DataFrame, width: int) -> DataFrame:
    """The rows with the class of their text; null for texts without words."""
    kind = docs.drop("__text").schema.add("__class", "long")
    at = docs.columns.index("__text")

    def take(batches):
        for b in batches:
            texts, found = b.column(at).to_pylist(), []
            for part in blocks(texts):
                w = hash_words(texts[part], SPACED)
                sets = (shingles(w.hashes[w.first[i] : w.first[i + 1]], width) for i in range(len(w.first) - 1))
                found += [_class(s) if len(s) else None for s in sets]
            yield [*[c for k, c in enumerate(b.columns) if k != at], found]

    return map_batches(docs, take, kind)


def without_near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, in the columns of docs: that with the component's least id, of the class that it belongs to.

    Decided by id and class, so rows that share an id but not their text are told apart. Defined results: rows without
    words are linked with nothing and all stay; of repeated rows one stays, the one with the least text where only case or blanks differ;
    rows without an id are members of their text's class, and one of them stays only where no member of the component has an id;
    an empty table stays empty; other columns are carried along.
    """
    _, classes, named = _resolved(docs, width, percent)
    owned = classes.join(named.select("class", "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    chosen = owned.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("blank"), "first", "class")).alias("m"))
    keys = {"__id": F.coalesce(F.col("m.first"), F.lit(0)), "__blank": F.col("m.first").isNull(), "__class": F.col("m.class")}
    chosen = chosen.select(*[c.alias(n) for n, c in keys.items()], F.lit(True).alias("__kept"))
    doc_id = F.col("doc_id").cast("long")
    rows = _with_class(docs.withColumn("__text", F.col("text").cast("string")), width)
    rows = rows.withColumns({"__id": F.coalesce(doc_id, F.lit(0)), "__blank": doc_id.isNull()})
    rows = rows.join(chosen, list(keys), "left").where("__kept or __class is null")
    # Rows without words are all different; the others lie with their equals already.
    rows = rows.withColumn("__own", F.when(F.col("__class").isNull(), F.monotonically_increasing_id()))
    rows = rows.withColumn("__turn", F.row_number().over(Window.partitionBy(*keys, "__own").orderBy("text")))
    return rows.where("__turn = 1").select(*[f"`{c}`" for c in docs.columns])
