"""Exact token counts at every prefix of a text, by dynamic programming.

For merge-based vocabularies a row of tokens is the encoding of a text if and only if every token is the
encoding of itself and every two neighbours are the encoding of their join. So each prefix has exactly one last
token that fits the last token of the prefix before it, and its count is that prefix's count plus one. No piece
reaches across certain places of a text (a blank after another character, a change between letters and
marks, a line break): there the text is cut, and the counts of each distinct cut are worked out once.

The counts answer how many tokens any prefix has and how far a budget reaches without encoding anything again.

Defined results: a null or empty text has no tokens; repeated rows are counted each; an empty table gives no rows;
other columns play no part.
"""

from __future__ import annotations

import itertools
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.encode import LETTERS
from evenkeel.llm.frames import id_and_text, map_batches
from evenkeel.llm.words import blocks

BLANK = "▁"
LIMIT = 4096
#: How many cuts, and how many pairs of tokens, a process remembers.
REMEMBERED = 300_000
_FINE = re.compile(f" *[{LETTERS}]+| *[^ {LETTERS}\n]+|\n| +")
_COARSE = re.compile(r" *[^ ]+| +")


class PrefixCounts:
    """Counts for one sentencepiece model of the merging kind."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        with open(path, "rb") as f:
            model = model_pb2.ModelProto.FromString(f.read())
        normal, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != 2 or not trained.byte_fallback or normal.precompiled_charsmap or normal.remove_extra_whitespaces:
            raise ValueError("a merging model with byte fallback and without text normalization is needed")
        if trained.treat_whitespace_as_suffix or not normal.escape_whitespaces:
            raise ValueError("blanks have to be marked at the beginning of words")
        self.dummy = normal.add_dummy_prefix
        model.normalizer_spec.add_dummy_prefix = False
        self.parts = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        pieces = [p.piece for p in model.pieces if p.type in (1, 4, 5)]
        # A piece that the merges never make can't be the last token of anything.
        self.vocabulary = {p for p, own in zip(pieces, self.parts.encode(pieces, out_type=str)) if own == [p]}
        self.characters = {p for p in pieces if len(p) == 1}
        self.longest = max(map(len, self.vocabulary))
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece reaches across a blank")
        letter = re.compile(f"[{LETTERS}]")
        across = {(bool(letter.match(a)), bool(letter.match(b))) for p in pieces for a, b in itertools.pairwise(p.lstrip(BLANK))}
        apart = (True, False) not in across and (False, True) not in across and not any("\n" in p for p in pieces)
        self.cuts = _FINE if apart else _COARSE
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        self.known: dict[str, tuple[int, ...]] = {}
        self.totals: dict[str, int] = {}

    def _fit(self, a: str, b: str) -> bool:
        if self.n_fits > REMEMBERED:
            self.fits.clear()
            self.n_fits = 0
        self.n_fits += 1
        ok = self.parts.encode(a + b, out_type=str) == [a, b]
        self.fits.setdefault(a, {})[b] = ok
        return ok

    def _learn(self, cuts: list[str]) -> None:
        """The count of every prefix of each cut. Sorted, neighbours share the work on what they have in common."""
        vocabulary, longest, fits = self.vocabulary, self.longest, self.fits
        before, counts, last = "", [0], [""]
        for cut in cuts:
            word = cut.replace(" ", BLANK)
            same = len(os.path.commonprefix((before, word)))
            del counts[same + 1 :], last[same + 1 :]
            for j in range(same + 1, len(word) + 1):
                for i in range(max(0, j - longest), j):
                    t = word[i:j]
                    if t in vocabulary:
                        p = last[i]
                        if p:
                            ok = fits[p].get(t) if p in fits else None
                            if not (self._fit(p, t) if ok is None else ok):
                                continue
                        counts.append(counts[i] + 1)
                        last.append(t)
                        break
                else:
                    c = word[j - 1]
                    if c in self.characters:
                        raise ValueError(f"no token ends {word[:j]!r}")
                    # Bytes stand for an unknown character, and nothing merges with them.
                    counts.append(counts[-1] + len(c.encode("utf-8", "surrogatepass")))
                    last.append("")
            before = word
            self.known[cut] = tuple(counts[1:])
            self.totals[cut] = counts[-1]

    def _cut(self, text: str) -> list[str]:
        return self.cuts.findall((" " * self.dummy + text).replace(BLANK, " "))

    def learn(self, texts: list[str | None]) -> list[list[str]]:
        """The cuts of the texts, all of them known from now on."""
        every = [self._cut(t) if t else [] for t in texts]
        new = set()
        for own in every:
            new.update(own)
        fresh = new.difference(self.totals)
        if len(self.totals) + len(fresh) > REMEMBERED:
            kept = new.difference(fresh)
            self.known = {c: self.known[c] for c in kept}
            self.totals = {c: self.totals[c] for c in kept}
        self._learn(sorted(fresh))
        return every

    def total_of(self, cuts: list[str]) -> int:
        return sum(map(self.totals.__getitem__, cuts))

    def total(self, text: str | None) -> int:
        """The count of the whole text."""
        return self.total_of(self.learn([text])[0])

    def prefixes(self, text: str | None) -> list[int]:
        """The count of the prefix of 0, 1, 2, ... characters."""
        if not text:
            return [0]
        out, before = [0], 0
        for c in self.learn([text])[0]:
            counts = self.known[c]
            out += [before + n for n in counts]
            before += counts[-1]
        return [0] + out[1 + self.dummy :]

    def reach(self, text: str | None, budget: int) -> int:
        """The length of the longest prefix of at most so many tokens."""
        if not text:
            return 0
        own, before, at, best = self.learn([text])[0], 0, -int(self.dummy), 0
        for c in own:
            counts = self.known[c]
            # A count may fall as a cut grows and its tokens merge; cuts before this one are settled.
            if before + min(counts) > budget:
                break
            best = max(best, at + max(k for k, n in enumerate(counts, 1) if before + n <= budget))
            before, at = before + counts[-1], at + len(c)
        return max(best, 0)


_models: dict[str, PrefixCounts] = {}


def counter(path: str) -> PrefixCounts:
    """The counts of a model, one per process."""
    if path not in _models:
        _models[path] = PrefixCounts(path)
    return _models[path]


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, reach): the counts, and how many characters fit into the limit."""

    def count(batches):
        c = counter(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = []
            for part in blocks(texts):
                n += [c.total_of(own) for own in c.learn(texts[part])]
            reach = [len(t or "") if k <= limit else c.reach(t, limit) for t, k in zip(texts, n)]
            yield [b.column(0), [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], n, reach]

    out = map_batches(id_and_text(docs), count, "doc_id bigint, n_bytes bigint, n_tokens bigint, reach bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, counts): the count at every prefix, stored for later questions."""

    def count(batches):
        c = counter(model)
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield [[doc], [c.prefixes(t)]]

    return map_batches(id_and_text(docs), count, "doc_id bigint, counts array<int>")
