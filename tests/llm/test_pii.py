import hashlib
import re

import pytest

from evenkeel.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


ODD = [
    "a@b.c@d.e x@y.z", "@a.b a@b a@.b", "..@a.b-c.d+e@f.g", "1.2.3.4.5.6.7.8 256.1.1.1 01.02.003.0004", "1.2.3.4@a.b",
    "4111 1111 1111 1111 4111-1111-1111-1112", "41111111111111111111111 +1 (974) 555-3436+1 2", "+1+2345678901 +12 3 (4) 5.6-7 8 9 0",
    "5" * 40 + " " + "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "é4111111111111111é 漢x@y.zü", "\x00\x1ca@b.c", "", "x" * 5000 + "@y.z",
]


@pytest.mark.parametrize("text", ODD)
def test_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    assert pii.base_spans("1" * 300_000 + " " + "a" * 300_000 + "@" + "1." * 100_000) is not None


def test_against_plain_patterns(documents):
    got = pii.find(documents).collect()
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    want = []
    for d, t in docs:
        spans = plain(t or "")
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want.append((d, *(sum(k == x for k, _, _ in spans) for x in pii.KINDS), hashlib.sha256(line.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    by_id = dict(docs)
    for r in got:
        if r["doc_id"] is not None:
            base = {f"{k}:{s}:{e}" for k, s, e in plain(by_id[r["doc_id"]] or "")}
            assert base <= set(r["spans"].split(","))


def brute_marginals(g, field):
    """Sums over all labelings."""
    import itertools

    import numpy as np

    k, n = len(pii.LABELS), len(g.spans)
    out = np.zeros((n, k))
    for ys in itertools.product(range(k), repeat=n):
        if any(f and f != y for f, y in zip(g.fixed, ys)):
            continue
        score = sum(field.unary.get(s, field.other)[y] for s, y, f in zip(g.shapes, ys, g.fixed) if not f)
        score += sum(field.chain[ys[i], ys[j]] for i, j in g.chain) + sum(field.skip[ys[i], ys[j]] for i, j in g.skip)
        for i, y in enumerate(ys):
            out[i, y] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def test_messages_are_exact_on_trees(field):
    text = "mail jo.smith77@mail.example and then 12 34, jo.smith77 wrote"
    g = pii._nodes(text, pii.base_spans(text))
    assert g.skip
    assert pii.marginals(g, field) == pytest.approx(brute_marginals(g, field), abs=1e-3)


def test_repeats_share_a_label(field):
    text = "call +1 (974) 555-3436 now. The number 974-555-3436 is new; jo.smith77@mail.example is jo.smith77, version 3 of 2024."
    base, every = pii.spans_of(text, field)
    added = {(k, text[s:e]) for k, s, e in every if (k, s, e) not in base}
    assert added == {("phone", "974-555-3436"), ("email", "jo.smith77")}
    assert set(base) <= set(every)


@pytest.mark.parametrize("n", [1, 2, 5, 50])
def test_evidence_reaches_every_repeat(n):
    import numpy as np

    none = np.log(np.array([0.96] + [0.01] * 4))
    for agree in (0.985, 0.998, 0.9998):
        strength = np.log(agree / (1 - agree)) + np.log(4)
        own = pii.Field({}, np.zeros((5, 5)), np.eye(5) * strength, none)
        text = "call +1-974-555-3436 " + "or then 974-555-3436 " * n
        base, every = pii.spans_of(text, own)
        assert len(base) == 1 and [k for k, _, _ in every] == ["phone"] * (n + 1)
        text = "call " + "974-555-3436 or then " * n + "jo@b.cd or +1-974-555-3436"
        assert len(pii.spans_of(text, own)[1]) == n + 2


@pytest.mark.parametrize("text, want", [
    ("call +49 170 1234567, or 0170 1234567, in short 0170 123 4567.", ["0170 1234567", "0170 123 4567"]),
    ("call +1 974 555 3436; in 2024 974 555 3436 or (974) 555-3436 rang", ["974 555 3436", "(974) 555-3436"]),
    ("card 4111 1111 1111 1111 as 12 4111 1111 1111 1111 and 124111 1111 1111 1111", ["4111 1111 1111 1111", "124111 1111 1111 1111"]),
    ("card 4111-1111-1111-1111 as 4111 1111 1111 1111 12", ["4111 1111 1111 1111"]),
    ("card 4111111111111111 as 124111111111111111", ["124111111111111111"]),
    ("call +49 170 1234567, 0171 123 4567 or 4567", ["0171 123 4567"]),
    ("call +49 170 1234567 of 12 13 14 15 16 17 18 19 20 0170 1234568", []),
    ("call +49 170 1234567 and +49 170 1234567", []),
])
def test_numbers_in_groups(text, want):
    import numpy as np

    own = pii.Field({}, np.zeros((5, 5)), np.eye(5) * (np.log(0.998 / 0.002) + np.log(4)), np.log(np.array([0.96] + [0.01] * 4)))
    base, every = pii.spans_of(text, own)
    assert [text[s:e] for k, s, e in sorted(every, key=lambda x: x[1]) if (k, s, e) not in base] == want
    assert set(base) <= set(every)


@pytest.mark.parametrize("n", [1, 2, 5, 50])
def test_repeats_with_the_trained_field(field, n):
    for first, again in (("call +1 (974) 555-3436", "974-555-3436"), ("call +49 170 1234567", "0170 1234567"), ("card 4111 1111 1111 1111", "12 4111 1111 1111 1111")):
        text = f"{first} now. " + f"The number {again} is new; " * n
        base, every = pii.spans_of(text, field)
        assert len(base) == 1 and len(every) == n + 1


def test_units_take_linear_time():
    text = "+49 170 1234567 " + "1 2 3 4 5 6 7 " * 20_000 + "+49 170 1234567"
    assert len(pii._nodes(text, pii.base_spans(text)).spans) > 0


def test_clean_texts_stay_clean(field):
    for text in ("in 2024 there were 974 555 3436 of 12.5", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "card 9807915762804490 and 9807915762804490"):
        assert pii.spans_of(text, field) == ([], [])


def test_mask(spark, documents, field):
    out = pii.mask(documents)
    assert out.columns == documents.columns and out.count() == documents.count()
    one = pii.masked_text("a jo@b.cd, 10.0.0.1!", field)
    assert one == "a <EMAIL>, <IP>!"
    assert not any(plain(r[0] or "") for r in out.select("text").collect())


def test_empty(empty):
    assert pii.find(empty).count() == 0
