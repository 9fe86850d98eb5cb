"""Check SQL of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

from evenkeel.llm import decontam, quality, url_filter

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def quality_rules() -> str:
    left = ["regexp_replace(t, '" + p.replace("'", "''") + "', '', 'g') AS t{0}" for p in quality.CLASSES.values()]
    chain = ", ".join(x.format(k + 1).replace("regexp_replace(t,", f"regexp_replace(t{k}," if k else "regexp_replace(t,", 1) for k, x in enumerate(left))
    n = len(left)
    chars = ", ".join(["length(t) - length(t1)"] + [f"length(t{k}) - length(t{k + 1})" for k in range(1, n)] + [f"length(t{n})"])
    own = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in quality.COMMON.items())
    langs = ", ".join(repr(x) for x in quality.COMMON)

    def js(p: str, q: str) -> str:
        part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (" + f"{p}[i] + {q}[i]" + ")) ELSE 0 END"
        terms = f"list_transform(range(1, len({p}) + 1), lambda i: ({part.format(p + '[i]')} + {part.format(q + '[i]')}) / 2)"
        return f"CASE WHEN {p} IS NOT NULL AND {q} IS NOT NULL THEN sqrt(greatest(0, list_reduce({terms}, lambda a, b: a + b))) END"

    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({langs}) THEN lang ELSE '' END AS ref FROM documents),
b AS (SELECT *, {chain}, regexp_extract_all(t, {_SPACED}) AS words, regexp_extract_all(lower(t), '[a-zà-ÿ]+') AS runs,
 CASE ref {own} END AS own FROM a),
c AS (SELECT doc_id, ref, t, t3, t5, t6, words, CAST(len(words) AS BIGINT) AS n_words, [{chars}] AS ch, length(t2) - length(t3) AS spaces,
 len(list_filter(words, lambda w: NOT regexp_matches(w, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]'))) AS bare,
 list_transform(own, lambda w: len(list_filter(runs, lambda x: x = w))) AS hits FROM b),
d AS (SELECT *, CASE WHEN hits IS NOT NULL THEN hits || [bare, greatest(0, n_words - list_sum(hits) - bare)] END AS co FROM c),
e AS (SELECT *, CASE WHEN list_sum(ch) > 0 THEN list_transform(ch, lambda x: CAST(x AS DOUBLE) / list_sum(ch)) END AS chars,
 CASE WHEN list_sum(co) > 0 THEN list_transform(co, lambda x: CAST(x AS DOUBLE) / list_sum(co)) END AS common FROM d),
o AS (SELECT ref, t, any_value(chars) AS chars, any_value(common) AS common FROM e WHERE n_words >= {quality.CHAR_WORDS} AND chars IS NOT NULL GROUP BY 1, 2),
oc AS (SELECT ref, unnest(chars) AS x, generate_subscripts(chars, 1) AS i FROM o),
ow AS (SELECT ref, unnest(common) AS x, generate_subscripts(common, 1) AS i FROM o WHERE ref <> ''),
rc AS (SELECT ref, i, CAST(sum(CAST(round(x * 1e9) AS BIGINT)) AS DOUBLE) / 1e9 / count(*) AS m FROM oc WHERE ref <> '' GROUP BY 1, 2
 UNION ALL SELECT '', i, CAST(sum(CAST(round(x * 1e9) AS BIGINT)) AS DOUBLE) / 1e9 / count(*) FROM oc GROUP BY 2),
rw AS (SELECT ref, i, CAST(sum(CAST(round(x * 1e9) AS BIGINT)) AS DOUBLE) / 1e9 / count(*) AS m FROM ow GROUP BY 1, 2),
fc AS (SELECT ref, list(m ORDER BY i) AS rchars FROM rc GROUP BY 1), fw AS (SELECT ref, list(m ORDER BY i) AS rcommon FROM rw GROUP BY 1),
w3 AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, n_words - 1)) AS i FROM c)),
tw AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM w3) WHERE k > 1),
rp AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tw) GROUP BY 1),
li AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_SPACED})) AS l FROM c),
f AS (SELECT e.doc_id, n_words, CAST(length(t) - spaces AS BIGINT) AS word_chars, CAST(length(t5) - length(t6) AS BIGINT) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
 {js('chars', 'rchars')} AS cd, {js('common', 'rcommon')} AS wd
 FROM e LEFT JOIN fc USING (ref) LEFT JOIN fw USING (ref) LEFT JOIN rp USING (doc_id) JOIN li USING (doc_id)),
g AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT coalesce((n_words >= {quality.CHAR_WORDS} AND cd > {quality.CHAR_LIMIT}) OR (n_words >= {quality.WORD_WORDS} AND wd > {quality.WORD_LIMIT}), false) AS kept,
 round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM g
"""


NGRAM_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, {_SPACED}) AS a FROM documents),
s AS (SELECT doc_id, CASE WHEN a IS NULL OR len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
 ELSE list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))) END AS g FROM w),
p AS (SELECT doc_id, unnest(g) AS x FROM s),
n AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM p a JOIN p b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM n JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * k >= 80 * (len(x.g) + len(y.g) - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""

WARC = """
WITH a AS (SELECT page_id, url, encode(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, url, octet_length(h) AS n, sha1(h) AS s FROM a),
c AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS o,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST((('0x' || substr(s, CAST(k // 4 * 5 + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS d FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> o THEN o END AS refers_to, url FROM c
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, {_ALNUM}), []) AS a FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, {_ALNUM}) AS a FROM benchmark),
q AS (SELECT DISTINCT item_id, least(10, len(a)) AS n, array_to_string(a[i:i + 9], ' ') AS g
 FROM (SELECT item_id, a, unnest(range(1, greatest(2, len(a) - 8))) AS i FROM b WHERE len(a) > 0)),
z AS (SELECT DISTINCT n FROM q),
t AS (SELECT doc_id, i, n, array_to_string(a[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, a, n, unnest(range(1, len(a) - n + 2)) AS i FROM d, z WHERE len(a) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM t JOIN q USING (g, n)),
c AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS k, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM h GROUP BY 1),
u AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS p FROM d),
f AS (SELECT x, count(*) AS n FROM u GROUP BY 1),
y AS (SELECT g, x, min(k) AS k FROM (SELECT g, unnest(y) AS x, generate_subscripts(y, 1) AS k FROM (SELECT DISTINCT g, string_split(g, ' ') AS y FROM q)) GROUP BY 1, 2),
o AS (SELECT g, x, n, least({decontam.NEAR_WORDS}, count(*) OVER w) AS m, row_number() OVER (w ORDER BY n IS NULL, n, k) AS r FROM y LEFT JOIN f USING (x) WINDOW w AS (PARTITION BY g)),
j AS (SELECT g, list(x ORDER BY r) AS xs FROM o WHERE r <= m GROUP BY g HAVING count(n) = any_value(m)),
v AS (SELECT xs, unnest(xs) AS x, len(xs) AS m FROM (SELECT DISTINCT xs FROM j)),
e AS (SELECT xs, doc_id, p FROM (SELECT DISTINCT xs FROM j) JOIN u ON u.x = xs[1]),
s AS (SELECT e.xs, e.doc_id, e.p FROM e JOIN v USING (xs) JOIN u ON u.doc_id = e.doc_id AND u.x = v.x AND u.p BETWEEN e.p - {decontam.NEAR_SPAN} AND e.p + {decontam.NEAR_SPAN}
 GROUP BY 1, 2, 3 HAVING count(DISTINCT v.x) = any_value(v.m)),
r AS (SELECT doc_id, count(DISTINCT item_id) AS k FROM (SELECT DISTINCT doc_id, xs FROM s) JOIN j USING (xs) JOIN q USING (g) GROUP BY 1)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(c.k, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.k, 0) AS BIGINT) AS n_items,
 sha256(coalesce(s, '')) AS items_sha256, coalesce(c.k, 0) > 0 AS contaminated,
 CAST(coalesce(r.k, 0) AS BIGINT) AS n_near FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id)
"""

RANKED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, {_ALNUM})) AS x FROM documents),
p AS (SELECT r, any_value(doc_id) AS doc_id, x, count(*) AS tf FROM d GROUP BY r, x),
s AS (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r),
a AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, {_ALNUM})) AS x FROM benchmark),
w AS (SELECT x, floor(1000 * ln(CAST(2 * (SELECT nn FROM a) + 2 AS DOUBLE) / (2 * count(*) + 1)))::BIGINT AS w FROM p WHERE x IN (SELECT x FROM q) GROUP BY x),
c AS (SELECT item_id, r, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l))) AS v FROM q JOIN w USING (x) JOIN p USING (x) JOIN s USING (r), a),
t AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(v)::BIGINT AS score FROM c GROUP BY item_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM t WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""

COLLOCATIONS = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS s FROM documents),
w AS (SELECT lang, regexp_extract_all(s, '[^\\x20\\x09]+') AS x FROM p),
g AS (SELECT lang, k, array_to_string(x[i:i + k - 1], ' ') AS phrase, array_to_string(x[i:i + k - 2], ' ') AS pre, array_to_string(x[i + 1:i + k - 1], ' ') AS suf
 FROM (SELECT lang, x, k, unnest(range(1, len(x) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(x) >= k)),
f AS (SELECT lang, k, phrase, any_value(pre) AS pre, any_value(suf) AS suf, count(*) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(x))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS y FROM f WHERE k > 1),
d AS (SELECT c.lang, c.k, c.phrase, c.a, j, l.a AS l, r.a AS r, CAST((c.a::HUGEINT * 2000000) // (l.a + r.a) AS BIGINT) AS score FROM c
 JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(y[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(y[j + 1:], ' ')),
e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
b AS (SELECT lang, phrase, max(a) AS m FROM (SELECT lang, pre AS phrase, a FROM f WHERE k > 2 UNION ALL SELECT lang, suf, a FROM f WHERE k > 2) GROUP BY 1, 2),
z AS (SELECT e.lang, row_number() OVER (PARTITION BY e.lang ORDER BY score DESC, a DESC, e.phrase) AS rank, e.phrase, a, l, r, n, score
 FROM e JOIN n ON n.lang = e.lang LEFT JOIN b ON b.lang = e.lang AND b.phrase = e.phrase WHERE m IS NULL OR 100 * m < 80 * a)
SELECT * FROM z WHERE rank <= 2000
"""


def url_filtering() -> str:
    u, order = url_filter, url_filter.ORDER
    rules = sorted(u.RULES, key=lambda r: (-len(r.name), -len(r.host), r.name))
    case = "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{{k}}}" for k, r in enumerate(rules)
    ) + " END"
    levels = ["l AS (SELECT '' AS gram, 1.0::DOUBLE / %d AS pa, 1.0::DOUBLE / %d AS pb)" % (u.ALPHABET, u.ALPHABET)]
    share = "CASE WHEN t{0} >= %d THEN ({0} + d{0} * p{0}) / (t{0} + d{0}) ELSE p{0} END AS p{0}" % u.MIN_CONTEXT
    for k in range(order + 1):
        levels.append(f"""g{k} AS (SELECT right(w, {k + 1}) AS gram, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM wi GROUP BY 1),
c{k} AS (SELECT *, sum(a) OVER c AS ta, sum(b) OVER c AS tb, count(*) FILTER (a > 0) OVER c AS da, count(*) FILTER (b > 0) OVER c AS db
 FROM g{k} WINDOW c AS (PARTITION BY left(gram, {k}))),
l{k} AS (SELECT c{k}.gram, {share.format('a')}, {share.format('b')} FROM c{k} JOIN l{k - 1 if k else ''} l ON l.gram = right(c{k}.gram, {k}))""")
    return f"""
WITH r AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT page_id, host, path, host || substr(rest, length(host) + 1) AS s,
 {case.format(*[repr(r.name) for r in rules])} AS rule, {case.format(*[repr(r.verdict) for r in rules])} AS kind FROM h),
u AS (SELECT s, count(*) AS n, any_value(kind) AS kind, ('0x' || substr(md5(s), 1, 4))::BIGINT % {u.HELD_OUT} = 0 AS held FROM f GROUP BY 1),
e AS (SELECT s, n, kind, held, unnest(list_transform(range(1, length(s) + 2), lambda i: substr(repeat(chr(2), {order}) || s || chr(3), i, {order + 1}))) AS w FROM u),
wi AS (SELECT w, sum(CASE WHEN kind = 'allow' AND NOT held THEN n ELSE 0 END) AS a, sum(CASE WHEN kind = 'block' AND NOT held THEN n ELSE 0 END) AS b FROM e GROUP BY 1),
{", ".join(levels)},
v AS (SELECT s, CAST(floor(CAST(sum(CAST(round({u.UNIT} * (ln(pa) - ln(pb))) AS BIGINT)) AS DOUBLE) / count(*)) AS BIGINT) AS score
 FROM e JOIN l{order} l ON l.gram = e.w GROUP BY 1),
b AS (SELECT floor(score / {u.STEP}.0)::BIGINT AS bin, sum(CASE WHEN kind = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN kind = 'block' THEN n ELSE 0 END) AS b
 FROM u JOIN v USING (s) WHERE held AND kind IS NOT NULL GROUP BY 1),
t AS (SELECT bin, sum(a) OVER () AS a_all, sum(b) OVER () AS b_all, coalesce(sum(a) OVER w, 0) AS a_low, coalesce(sum(b) OVER w, 0) AS b_low
 FROM b WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT coalesce((SELECT bin * {u.STEP} FROM t WHERE a_all > 0 AND b_all > 0 ORDER BY (a_all - a_low) * b_all + b_low * a_all DESC, abs(bin), bin LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, score, CAST(cut AS BIGINT) AS "limit"
FROM f JOIN v USING (s), z
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_collocations": COLLOCATIONS,
        "op11_ranked_search": RANKED_SEARCH,
        "op13_url_filter": url_filtering(),
        "op3_quality_rules": quality_rules(), "op4_ngram_jaccard_join": NGRAM_JACCARD, "op5_warc": WARC,
        "op6_benchmark_decontamination": DECONTAMINATION,
    }
