"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are held against those of its
language by the Jensen-Shannon distance. The references are gathered from the whole corpus: the mean histograms of the
distinct texts of a language that are long enough to judge. A document is rejected if a distance is beyond its threshold
and the text is long enough for that histogram; shorter ones keep the benefit of the doubt. Languages
without a word list, and documents without a language, are held against the mean of all languages' characters
only. Base rules (too few words, too much repetition) reject whatever the distances say.

Everything is built from DataFrame functions and runs per row, but for the references, of which there is one per language.

Defined results: a null or empty text has no words and is rejected by the base rules; repeated rows are judged each;
an empty table gives no rows; other columns are passed on untouched by ``kept_only`` and play no part otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.session import materialise

MIN_WORDS = 50
MOST_REPEATED = 50
CHAR_LIMIT, CHAR_WORDS = 0.30, 50
WORD_LIMIT, WORD_WORDS = 0.38, 100
#: Classes of characters, taken out of the text one after the other; what is left is beyond ASCII.
CLASSES = {
    "lower": r"[a-z]+", "upper": r"[A-Z]+", "space": r"[\x20\x09-\x0D]+", "digit": r"[0-9]+",
    "mark": r"[.,;:!?'\"()\-]+", "symbol": r"[#*$%&|<>]+", "other": r"[\x00-\x7F]+",
}
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "on", "are"),
    "de": ("der", "die", "und", "das", "nicht", "mit", "von", "ist", "den", "auf", "ein", "zu"),
    "fr": ("de", "la", "le", "et", "les", "des", "un", "une", "dans", "que", "est", "pour"),
    "es": ("de", "la", "que", "el", "en", "los", "del", "las", "por", "con", "una", "para"),
}
WORD = r"[^\x20\x09-\x0D]+"
#: Words without a letter.
_BARE = r"(?:^|[\x20\x09-\x0D])[^\x20\x09-\x0DA-Za-z\x{80}-\x{10FFFF}]+(?=[\x20\x09-\x0D]|$)"
_LETTER = "[a-zà-ÿ]"
_BINS = len(COMMON["en"])


def _repeated_words() -> tuple[str, ...]:
    """SQL steps that count the words in 3-word windows that occur twice or more.

    Windows' hashes and places share one number each; sorted, equal windows are neighbours. So the
    work for a text is that of sorting its windows.
    """
    windows = "transform(sequence(0, n_words - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"
    packed = "transform(hashes, (h, i) -> shiftleft(shiftright(h, bits), bits) | i)"
    same = "shiftright(x, bits) = shiftright(sorted[{0}], bits) and hashes[int(x & mask)] = hashes[int(sorted[{0}] & mask)]"
    twice = (
        "filter(sorted, (x, k) -> case when k > 0 and " + same.format("k - 1") + " then true "
        "when k + 1 < n_words - 2 and " + same.format("k + 1") + " then true else false end)"
    )
    places = "sort_array(transform(twice, x -> x & mask))"
    covered = "aggregate(transform(places, (x, k) -> least(3, coalesce(get(places, k + 1), x + 3) - x)), 0L, (a, x) -> a + x)"
    return windows, packed, twice, places, covered


def measured(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents with a struct column __m of their counts and histograms."""
    language = F.col(f"`{lang}`").cast("string") if lang in docs.columns else F.lit(None).cast("string")
    df = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t0"), language.alias("lang"))
    names = list(CLASSES)
    for k, name in enumerate(names):
        df = df.withColumn(f"t{k + 1}", F.regexp_replace(f"t{k}", CLASSES[name], ""))
    counts = [F.char_length(f"t{k}") - F.char_length(f"t{k + 1}") for k in range(len(names))] + [F.char_length(f"t{len(names)}")]
    df = df.select(
        "__row", "lang", F.col("t0").alias("text"), F.array(*[c.cast("double") for c in counts]).alias("chars"),
        F.char_length("t0").alias("n_chars"), F.regexp_extract_all("t0", F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        F.lower("t0").alias("low"), F.regexp_count("t0", F.lit(_BARE)).alias("bare"),
    ).withColumn("n_words", F.size("words"))
    listed = F.coalesce(F.col("lang").isin(*COMMON), F.lit(False))
    df = df.withColumn("ref", F.when(listed, F.col("lang")).otherwise(F.lit("")))

    def by_language(make):
        return reduce(lambda rest, k: F.when(F.col("ref") == k, make(COMMON[k])).otherwise(rest), COMMON, F.lit(None))

    found = by_language(
        lambda own: F.regexp_extract_all("low", F.lit(f"(?:^|[^a-zà-ÿ])({'|'.join(own)})(?!{_LETTER})"), F.lit(1))
    )
    df = df.withColumn("found", found).drop("low")

    def tally(own):
        hits = [F.size(F.expr(f"filter(found, x -> x = '{w}')")) for w in own]
        rest = F.greatest(F.col("n_words") - F.size("found") - F.col("bare"), F.lit(0))
        return F.array(*[h.cast("double") for h in [*hits, F.col("bare"), rest]])

    df = df.withColumn("common", by_language(tally)).drop("found", "bare")
    windows, packed, twice, places, covered = _repeated_words()
    none = "cast(array() as array<bigint>)"
    df = df.withColumn("hashes", F.expr(f"case when n_words >= 3 then {windows} else {none} end"))
    df = df.withColumn("bits", F.expr("cast(length(bin(n_words)) as int)")).withColumn("mask", F.expr("cast(shiftleft(1L, bits) - 1 as int)"))
    df = df.withColumn("sorted", F.sort_array(F.expr(packed)))
    df = df.withColumn("twice", F.expr(twice))
    df = df.drop("hashes", "sorted").withColumn("places", F.expr(places)).withColumn("n_repeat_words", F.expr(covered))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    symbols = F.expr("chars")[names.index("symbol")].cast("long")
    return df.select(
        "__row",
        F.struct(
            "ref", F.xxhash64("text").alias("same"), F.col("n_words").cast("long").alias("n_words"),
            (F.col("n_chars") - F.expr("chars")[names.index("space")]).cast("long").alias("word_chars"), symbols.alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
            _shares("chars").alias("chars"), _shares("common").alias("common"),
            # Filters on the measures ask for this number too, so that the optimizer doesn't write all of the above into them.
            F.monotonically_increasing_id().alias("id"),
        ).alias("__m"),
    )


def _shares(name: str) -> Column:
    """A histogram divided by its sum; null where there is nothing."""
    total = F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(name, lambda x: x / total))


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float] | None]]:
    """Mean histograms by language, and of all under "": over the distinct texts long enough to judge. A row per language."""
    n_chars = len(CLASSES) + 1
    m = rows.select("__m.*").where((F.col("id") >= 0) & (F.col("n_words") >= CHAR_WORDS) & F.col("chars").isNotNull())
    one = m.groupBy("ref", "same").agg(
        *[F.max(F.col("chars")[i]).alias(f"c{i}") for i in range(n_chars)],
        *[F.max(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(_BINS + 2)],
    )
    # Means of whole billionths: sums don't depend on the order in which tasks end.
    means = [F.sum(F.round(F.col(c) * 1e9).cast("long")).alias(c) for c in one.columns[2:]]
    out, every, n_every = {}, [0] * n_chars, 0
    for r in one.groupBy("ref").agg(F.count("*").alias("n"), *means).collect():
        chars = [r[f"c{i}"] for i in range(n_chars)]
        every, n_every = [a + b for a, b in zip(every, chars)], n_every + r["n"]
        if r["ref"]:
            out[r["ref"]] = ([x / 1e9 / r["n"] for x in chars], [r[f"w{i}"] / 1e9 / r["n"] for i in range(_BINS + 2)])
    if n_every:
        out[""] = ([x / 1e9 / n_every for x in every], None)
    return out


def js_distance(p: str, q: list[float]) -> Column:
    """The Jensen-Shannon distance (base 2) of an array column from a fixed histogram; 0 to 1."""
    fixed = "array(" + ", ".join(f"{x!r}D" for x in q) + ")"
    part = "case when {0} > 0 then {0} * log2(2 * {0} / (a + b)) else 0D end"
    terms = f"zip_with({p}, {fixed}, (a, b) -> ({part.format('a')} + {part.format('b')}) / 2)"
    return F.expr(f"sqrt(greatest(0D, aggregate({terms}, 0D, (s, x) -> s + x)))")


def judged(rows: DataFrame, refs: dict) -> DataFrame:
    """The rows with char_distance, word_distance, base_failed and kept."""
    df = rows.select("*", "__m.*")
    char, word = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (chars, words) in refs.items():
        char = F.when(F.col("ref") == name, js_distance("chars", chars)).otherwise(char)
        if words:
            word = F.when(F.col("ref") == name, js_distance("common", words)).otherwise(word)
    df = df.withColumn("char_distance", char).withColumn("word_distance", word)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    far = ((F.col("n_words") >= CHAR_WORDS) & (F.col("char_distance") > CHAR_LIMIT)) | (
        (F.col("n_words") >= WORD_WORDS) & (F.col("word_distance") > WORD_LIMIT)
    )
    return df.withColumn("base_failed", base).withColumn("kept", ~base & ~F.coalesce(far, F.lit(False)))


def verdicts(docs: DataFrame) -> DataFrame:
    """A row of counts, distances and verdict per document. The texts are read once; their measures go to the shared folder."""
    slim = docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else []))
    rows = measured(slim).select(F.struct(F.col("__row.doc_id").cast("long").alias("doc_id")).alias("__row"), "__m")
    rows = materialise(rows, "measures")
    return judged(rows, references(rows)).select(
        "__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


def kept_only(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    refs = references(measured(docs))
    return judged(measured(docs), refs).where("id >= 0 and kept").select("__row.*")
