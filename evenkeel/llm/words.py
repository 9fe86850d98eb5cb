"""Words of whole texts as 64-bit numbers, worked out with numpy on the UTF-8 bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACES = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 2_000_000


def _lowered(separators: Iterable[int], lower: bool) -> bytes:
    """A translation table: separators become spaces, A-Z becomes a-z if asked for."""
    table = bytearray(range(256))
    if lower:
        table[65:91] = bytes(range(97, 123))
    for b in separators:
        table[b] = 32
    return bytes(table)


#: Words are runs without white space; A-Z is lower-cased.
SPACED = _lowered(_SPACES, True)
#: Words are runs of digits, ASCII letters and all characters beyond ASCII; A-Z is lower-cased first.
ALNUM = _lowered([*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)], True)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes than this are hashed one by one.
LONG = 256


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; the data needs 8 more bytes behind the last run.

    Eight bytes at a time enter through a mixing step that depends on all bytes before them, so no two
    words are equal for a reason that lies in their pattern.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lanes = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    sizes = ends - starts
    h = mixed(sizes.astype(np.uint64) * _STEP + (lanes[starts] & _MASKS[np.minimum(sizes, 8)]))
    rest, done = np.flatnonzero((sizes > 8) & (sizes <= LONG)), 8
    while len(rest):
        lane = lanes[starts[rest] + done] & _MASKS[np.minimum(sizes[rest] - done, 8)]
        h[rest] = mixed(h[rest] * _ODD + lane)
        done += 8
        rest = rest[sizes[rest] > done]
    for k in np.flatnonzero(sizes > LONG):
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


@dataclass(frozen=True)
class Words:
    """hashes: one per word, in order; first: where each text's words begin, with the total at the end."""

    hashes: np.ndarray
    first: np.ndarray


def hash_words(texts: list[str | None], table: bytes) -> Words:
    """The words of each text as 64-bit hashes. A missing text has none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(table) + b" " * 9, np.uint8)
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1] if raw else np.zeros(0, np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], data != 32]).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    first = np.append(np.searchsorted(starts, begins), len(starts))
    return Words(hash_runs(data, starts, ends), first)


def blocks(texts: list[str | None], most: int = BLOCK_BYTES) -> Iterator[slice]:
    """Slices of texts of about so many characters each; a longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and size + n > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct runs of so many words, sorted; a shorter text is one run; no words, no run."""
    n = len(hashes)
    if not n:
        return hashes
    if n < width:
        s = hashes[:1] + np.uint64(n)
        for h in hashes[1:]:
            s = mixed(s) + h
        return mixed(s)
    s = hashes[: n - width + 1] + np.uint64(width)
    for k in range(1, width):
        s = mixed(s)
        s += hashes[k : n - width + 1 + k]
    return np.unique(mixed(s))
