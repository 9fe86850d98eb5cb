"""Personal data by patterns and a skip-chain conditional random field.

Patterns find mail and network addresses, card and phone numbers; these spans always stand. A field over
the tokens that could be personal data (those with digits or an @) adds what patterns miss: a token's own shape,
its neighbours' labels and, over any distance, tokens that repeat it or resemble it (the same digits,
the same address or its local part) share potentials. Numbers written in groups are one token: those that a pattern has found, and groups in
a row whose digits are those of a found number, end in them or share their last 7. Loopy sum-product message passing settles each document; tokens
that a pattern has found are fixed. Repeats of a token are linked in a row, and each one is also linked to the nearest one that a
pattern has found: its evidence doesn't have to pass through other repeats, and links stay linear in the number of tokens.

The field is trained on the corpus itself with the patterns' labels: one pass counts shapes with labels, pairs of
neighbours and pairs of linked tokens over all documents; the weights are fitted to these counts, whose
number is that of shapes and labels. As the patterns miss some, a share of the labels is taken to be wrong.

Defined results: a null or empty text has no spans; repeated rows are read each; an empty table gives no rows and an
untrained field adds nothing; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.frames import id_and_text, map_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Share of pattern labels taken to be wrong, least probability of an added span.
NOISE = 0.05
SURE = 0.6
#: Messages are passed until none moves by more than this; damping grows after so many rounds, for loops that swing.
SETTLED = 1e-4
ROUNDS = 100
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin within a run of digits: the run's first digit would have matched before.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile("[0-9@]")
_TOKEN = re.compile("[^\x20\x09-\x0d]+")
_RUN = re.compile(r"[0-9](?:[\x20().-]*+[0-9])*+")
_GROUP = re.compile("[0-9]+")
_TRIM = re.compile(r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the patterns, by kind and place."""
    if not _HINT.search(text):
        return []
    out = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


@dataclass
class _Nodes:
    """Candidate tokens of a text: core spans, shapes, fixed labels (0: none) and links; the first ``rows`` skip links are those of repeats in a row."""

    spans: list[tuple[int, int]]
    shapes: list[str]
    fixed: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    rows: int = 0


def _shape(core: str, before: str) -> str:
    """A token's shape: kinds of characters, how many digits, and whether a plus sign leads."""
    digits = sum("0" <= c <= "9" for c in core)
    marks = "".join(sorted({c for c in core if c in "@.-+/:()"}))
    letters = "a" if any(c.isalpha() for c in core) else ""
    luhn = "L" if 13 <= digits <= 19 and _luhn(_digits(core)) else ""
    return f"{min(digits, 20)}{letters}{marks}{luhn}{'<' if before.startswith('+') else ''}"


def _keys(core: str) -> list[str]:
    """What a token has in common with those that repeat or resemble it."""
    if "@" in core:
        return ["m" + core.lower(), "l" + core.lower().partition("@")[0]]
    digits = _digits(core)
    if any(c.isalpha() for c in core):
        return ["l" + core.lower()] if len(core) >= 5 and digits else []
    if core.count(".") == 3:
        return ["i" + core]
    return _digit_keys(digits)


def _digits(core: str) -> str:
    return "".join(c for c in core if "0" <= c <= "9")


def _digit_keys(digits: str) -> list[str]:
    return (["d" + digits] if len(digits) >= 12 else []) + (["p" + digits[-7:]] if 7 <= len(digits) <= 15 else [])


@dataclass
class _Numbers:
    """The digits of found numbers, the ends of 7 digits or more of those that can be phone numbers, and the shortest of these by their last 7."""

    whole: set[str]
    tails: set[str]
    shortest: dict[str, int]


def _first_group(digits: str, begins: list[int], ends: list[int], marks: list[bool], j: int, found: _Numbers) -> tuple[int, list[str]] | None:
    """(first group, keys) of the unit that ends with group j and resembles a found number."""
    last = digits[max(0, ends[j] - 7) : ends[j]]
    shortest, part, fused = found.shortest.get(last), None, None
    for i in range(j, -1, -1):
        own = digits[begins[i] : ends[j]]
        if own in found.whole:
            return i, _digit_keys(own)
        if fused is None:
            f = next((own[-n:] for n in range(min(19, len(own) - 1), 6, -1) if own[-n:] in found.whole), None)
            fused = (i, _digit_keys(f)) if f else None
        if own.lstrip("0") in found.tails:
            part = i
        if len(own) >= 19:
            break
    if part is None and fused is not None:
        return fused
    if shortest is None:
        return None
    if part is None:
        part = next((i for i in range(j, -1, -1) if ends[j] - begins[i] >= 7), 0)
    # The area code belongs to it, also where it is another one: the nearest group before that begins with 0, a plus or a bracket.
    if digits[begins[part]] != "0" and not marks[part] and ends[j] - begins[part] < shortest:
        for i in range(part - 1, -1, -1):
            if ends[j] - begins[i] > 15:
                break
            if marks[i] or digits[begins[i]] == "0":
                part = i
                break
    return (part, ["p" + last]) if ends[j] - begins[part] <= 15 else None


def _units(text: str, places: list[tuple[int, int, int]], starts: list[int]) -> list[tuple[int, int, int, list[str]]]:
    """Numbers of several tokens, or with digits before them: (start, end, label or 0, keys), by place and apart from one another.

    ``places`` are the patterns' spans (start, end, label), ``starts`` their starts. Work is linear: a unit has 19 groups at most.
    """
    numbers = [p for p in places if LABELS[p[2]] in ("card", "phone")]
    if not numbers:
        return []
    out, found, ends7 = [], _Numbers(set(), set(), {}), set()
    for s, e, y in numbers:
        digits = _digits(text[s:e])
        found.whole.add(digits)
        ends7.add(digits[-7:])
        if len(digits) <= 15:
            found.tails.update(digits[k:] for k in range(len(digits) - 6))
            found.shortest[digits[-7:]] = min(len(digits), found.shortest.get(digits[-7:], 15))
        if _TOKEN.match(text, s).end() < e and (not out or out[-1][1] <= s):
            out.append((s, e, y, _digit_keys(digits)))
    for m in _RUN.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        # Parts of the run that no pattern has found.
        parts, part = [], []
        for s, e in groups:
            if any(a < e and s < b for a, b, _ in _around(places, starts, s, e)):
                parts.append(part)
                part = []
            else:
                part.append((s, e))
        for part in (*parts, part):
            if not part:
                continue
            digits = "".join(text[s:e] for s, e in part)
            begins, ends, n = [], [], 0
            for s, e in part:
                begins.append(n)
                n += e - s
                ends.append(n)
            marks = [s > 0 and text[s - 1] in "(+" for s, _ in part]
            j = len(part) - 1
            while j >= 0:
                hit = _first_group(digits, begins, ends, marks, j, found) if digits[max(0, ends[j] - 7) : ends[j]] in ends7 else None
                if hit is None:
                    j -= 1
                    continue
                i, keys = hit
                s, e = part[i][0], part[j][1]
                if s > 0 and (text[s - 1] == "+" or text[s - 1] == "(" and ")" in text[s:e]):
                    s -= 1
                one = _TOKEN.match(text, s)
                # A number that is a token of its own has its keys already, if these are all.
                if one.end() < e or keys[0] not in _keys(_TRIM.sub("", one[0])) and not any(c.isalpha() or c == "@" for c in one[0]):
                    out.append((s, e, 0, keys))
                j = i - 1
    return sorted(out)


def _around(places, begins: list[int], start: int, end: int):
    """The spans that may touch [start, end): one of each kind may begin before it."""
    return places[max(0, bisect_right(begins, start) - len(KINDS)) : bisect_right(begins, end)]


def _nodes(text: str, spans: list[tuple[str, int, int]]) -> _Nodes:
    places = sorted((s, e, KINDS.index(k) + 1) for k, s, e in spans)
    begins = [p[0] for p in places]
    out, last, order, linked = _Nodes([], [], [], [], []), None, 0, {}
    before = ""

    def add(start, end, shape, label, keys):
        nonlocal last
        n = len(out.spans)
        out.spans.append((start, end))
        out.shapes.append(shape)
        out.fixed.append(label)
        if last is not None and last[1] == order - 1:
            out.chain.append((last[0], n))
        last = n, order
        for key in keys:
            linked.setdefault(key, []).append(n)

    units = _units(text, places, begins)
    u = 0
    for m in _TOKEN.finditer(text):
        # A unit takes the place of the tokens that it covers.
        while u < len(units) and units[u][1] <= m.start():
            u += 1
        if u < len(units) and units[u][0] < m.end():
            while u < len(units) and units[u][0] < m.end():
                start, end, label, keys = units[u]
                if start >= m.start():
                    order += 1
                    add(start, end, _shape(text[start:end], before), label, keys)
                if end > m.end():
                    break
                u += 1
            before = m[0]
            continue
        order += 1
        token = m[0]
        if not _HINT.search(token):
            before = token
            continue
        lead = _TRIM.match(token)
        start = m.start() + (lead.end() if lead and lead.start() == 0 else 0)
        core = _TRIM.sub("", token)
        if not core:
            before = token
            continue
        end = start + len(core)
        label = next((y for s, e, y in _around(places, begins, start, end) if s < end and e > start), 0)
        add(start, end, _shape(core, before), label, _keys(core))
        before = token
    _link(out, linked.values())
    return out


def _link(g: _Nodes, groups) -> None:
    """Skip links of groups of like tokens: in a row, and from each to the nearest one that a pattern has found."""
    row = dict.fromkeys(sorted((i, j) for x in groups for i, j in zip(x, x[1:])))
    near = {}
    for x in groups:
        found = [i for i in x if g.fixed[i]]
        for i in x if found else ():
            if not g.fixed[i]:
                k = bisect_right(found, i)
                f = min(found[max(0, k - 1) : k + 1], key=lambda f: abs(f - i))
                near[min(i, f), max(i, f)] = None
    g.rows = len(row)
    g.skip = [*row, *(e for e in sorted(near) if e not in row)]


@dataclass
class Field:
    """Log-potentials: by shape and label, and between labels of neighbours and of linked tokens."""

    unary: dict[str, np.ndarray]
    chain: np.ndarray
    skip: np.ndarray
    other: np.ndarray


def _features(shape: str) -> list[str]:
    digits = re.match(r"\d+", shape)[0]
    return ["1", "n" + digits, "s" + shape[len(digits):], *("c" + c for c in shape[len(digits):])]


def train(docs: DataFrame) -> Field | None:
    """Fit the field to the patterns' labels of all documents. Counts of shapes and label pairs reach the driver."""

    def count(batches):
        c: Counter = Counter()
        for b in batches:
            for t in b.column(1).to_pylist():
                if not t or not _HINT.search(t):
                    continue
                g = _nodes(t, base_spans(t))
                c.update(("u", s, y, 0) for s, y in zip(g.shapes, g.fixed))
                c.update(("c", "", g.fixed[i], g.fixed[j]) for i, j in g.chain)
                c.update(("s", "", g.fixed[i], g.fixed[j]) for i, j in g.skip[: g.rows])
        if c:
            keys = sorted(c)
            yield [*(list(x) for x in zip(*keys)), [c[k] for k in keys]]

    rows = map_batches(docs, count, "kind string, shape string, a int, b int, n bigint")
    rows = rows.groupBy("kind", "shape", "a", "b").agg(F.sum("n").alias("n")).orderBy("kind", "shape", "a", "b").collect()
    shapes = sorted({r["shape"] for r in rows if r["kind"] == "u"})
    if not shapes:
        return None
    at = {s: i for i, s in enumerate(shapes)}
    seen, pairs = np.zeros((len(shapes), len(LABELS))), {k: np.ones((len(LABELS), len(LABELS))) for k in "cs"}
    for r in rows:
        if r["kind"] == "u":
            seen[at[r["shape"]], r["a"]] += r["n"]
        else:
            pairs[r["kind"]][r["a"], r["b"]] += r["n"]
            pairs[r["kind"]][r["b"], r["a"]] += r["n"]
    names = sorted({f for s in shapes for f in _features(s)})
    x = np.zeros((len(shapes), len(names)))
    for s in shapes:
        for f in _features(s):
            x[at[s], names.index(f)] = 1
    # Maximum entropy over the counts of shapes, by gradient steps with a small penalty.
    mass = seen.sum(axis=1, keepdims=True)
    weight = mass / mass.sum()
    target, w, step = seen / mass, np.zeros((len(names), len(LABELS))), np.zeros((len(names), len(LABELS)))
    for _ in range(400):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        step = 0.9 * step + x.T @ ((target - p) * weight) - 1e-5 * w
        w += 2.0 * step

    def noisy(z):
        p = np.exp(z - z.max())
        return np.log((1 - NOISE) * p / p.sum() + NOISE / len(LABELS))

    def ratio(n):
        joint = n / n.sum()
        alone = joint.sum(axis=1)
        return np.log(joint / np.outer(alone, alone))

    # Linked tokens: how often they agree, whatever the label; at least as strong as one case against twenty.
    agree = max(np.trace(pairs["s"]) / pairs["s"].sum(), 20 / 21)
    strength = np.log(agree / (1 - agree)) + np.log(len(LABELS) - 1)
    return Field(
        {s: noisy(x[at[s]] @ w) for s in shapes}, np.clip(ratio(pairs["c"]), -1.5, 1.5), np.eye(len(LABELS)) * strength,
        noisy(np.zeros(len(LABELS)) + np.array([3.0] + [0.0] * len(KINDS))),
    )


def marginals(g: _Nodes, field: Field) -> np.ndarray:
    """Probabilities of the labels of each node by loopy sum-product with damping."""
    n, k = len(g.spans), len(LABELS)
    unary = np.array([field.unary.get(s, field.other) for s in g.shapes]).reshape(n, k)
    for i, y in enumerate(g.fixed):
        if y:
            unary[i] = np.where(np.arange(k) == y, 0.0, -np.inf)
    edges = [(i, j, field.chain) for i, j in g.chain] + [(i, j, field.skip) for i, j in g.skip]
    if not edges:
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    src = np.array([i for i, _, _ in edges] + [j for _, j, _ in edges])
    dst = np.array([j for _, j, _ in edges] + [i for i, _, _ in edges])
    pot = np.array([m for *_, m in edges] + [m.T for *_, m in edges])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    msg = np.zeros((len(src), k))
    for step in range(10 * ROUNDS):
        total = unary.copy()
        np.add.at(total, dst, msg)
        out = (total[src] - msg[back])[:, :, None] + pot
        top = out.max(axis=1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        if np.abs(new - msg).max() < SETTLED:
            msg = new
            break
        keep = 1 - 0.5 / (1 + step // ROUNDS)
        msg = keep * msg + (1 - keep) * new
    total = unary.copy()
    np.add.at(total, dst, msg)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def spans_of(text: str, field: Field | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(the patterns' spans, all spans) of a text, by kind and place."""
    base = base_spans(text)
    if field is None or not _HINT.search(text):
        return base, base
    g = _nodes(text, base)
    # Without a pattern's find and without links, a token's own shape never suffices.
    if not any(g.fixed):
        return base, base
    p = marginals(g, field)
    best = p.argmax(axis=1)
    joined = {i for pair in g.skip for i in pair}
    taken = [(s, e) for _, s, e in base]
    more = []
    for i in np.flatnonzero(best):
        s, e = g.spans[i]
        if not g.fixed[i] and i in joined and p[i, best[i]] >= SURE and not any(a < e and s < b for a, b in taken):
            more.append((KINDS[best[i] - 1], s, e))
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))


def _line(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    docs = id_and_text(docs)
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))
    nothing = hashlib.sha256(b"").hexdigest()

    def read(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                base, every = spans_of(t, sent.value) if t else ([], [])
                n = Counter(k for k, _, _ in base)
                row = [n[k] for k in KINDS] + [hashlib.sha256(_line(base).encode()).hexdigest() if base else nothing, _line(every)]
                for column, x in zip(out, row):
                    column.append(x)
            yield [b.column(0), *out]

    kind = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return map_batches(docs, read, kind)


def masked_text(text: str | None, field: Field | None) -> str | None:
    """The text with each span replaced by the name of its kind."""
    if not text:
        return text
    _, spans = spans_of(text, field)
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < at:  # spans of several kinds may overlap
            if e > at:
                at = e
            continue
        out += [text[at:s], f"<{kind.upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """The documents with masked texts and, where there is that column, their new lengths; all other columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(train(id_and_text(docs)))
    place = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def rewrite(batches):
        for b in batches:
            columns = list(b.columns)
            texts = columns[place].to_pylist()
            columns[place] = [masked_text(t, sent.value) for t in texts]
            if size is not None:
                old = columns[size].to_pylist()
                columns[size] = [o if t == m else len(m) for o, t, m in zip(old, texts, columns[place])]
            yield columns

    return map_batches(docs, rewrite, docs.schema)
