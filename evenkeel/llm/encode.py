"""Token ids of whole texts, with each distinct word piece encoded once.

The pre-tokenizers in use never look across certain places of a text: before a lone blank between
two words, around a line break, and between a run of letters and a mark of punctuation. Texts are cut there, each
distinct cut is encoded by the tokenizers library once and remembered, and a text's ids are those of its
cuts in a row. A text in which an added token is spelled out, and any tokenizer of another kind, goes
to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode's White_Space, and letters of the Latin blocks.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
_END = r"(?=[\x00-/:-@\[-`{-\x7f]|\Z)"
#: Blanks count: a word keeps the blank before it.
_KEEPING = re.compile(f" ?[{LETTERS}]+{_END}| ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: White space is dropped.
_DROPPING = re.compile(f"[{LETTERS}]+{_END}|[^{_WHITE}]+")
#: How many cuts a process remembers; the ones met again lately are kept longest.
REMEMBERED = 400_000


def _byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Known(dict):
    """Ids by cut; an unknown cut is encoded when it is first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, cut):
        ids = self.older.get(cut)
        if ids is None:
            ids = self.encode(cut)
        self[cut] = ids
        return ids

    def age(self):
        if len(self) > REMEMBERED // 2:
            self.older = dict(self)
            self.clear()


class Encoder:
    """A tokenizers file and the ids of the cuts met so far, as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size(True)
        before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = before.get("pretokenizers", [])
        self.lowers, self.cuts = False, None
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal:
            self.cuts = _KEEPING
        elif (
            [p.get("type") for p in parts] == ["Split", "ByteLevel"] and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
            and [n.get("type") for n in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        ):
            self.cuts, self.lowers = _DROPPING, True
        self.model, self.alphabet = self.tokenizer.model, _byte_alphabet()
        self.letters = re.compile(f" ?[{LETTERS}]+")
        self.known = _Known(self._cut_ids)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cut_ids(self, cut: str) -> bytes:
        if not self.letters.fullmatch(cut):
            return self._plain(cut)
        # A run of letters is one unit of the pre-tokenizer: its bytes go to the merges straight away.
        if self.lowers:
            cut = cut.lower()
        ids = [t.id for t in self.model.tokenize(cut.encode().decode("latin-1").translate(self.alphabet))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes, four to an id. A missing text has none."""
        out = []
        for t in texts:
            t = t or ""
            if self.cuts is None or "\u180e" in t or any(a in t for a in self.added):
                out.append(self._plain(t))
                continue
            if self.lowers and t.isascii():
                t = t.lower()
            out.append(b"".join(map(self.known.__getitem__, self.cuts.findall(t))))
            self.known.age()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, one per process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
