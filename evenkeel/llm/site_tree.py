"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of style nodes: a node is a path of elements with their
classes, below it the texts and the arrangements of children that its pages show there. A leaf's texts that recur on
many pages say little; an inner node whose pages are all arranged alike says little of its own. So a node's importance
is put together from the entropy of its arrangements and the importance of what lies below, and branches of low
importance are cut out of every page. Pages of a host whose article's texts are the same (all texts, where no article is marked)
count once, whatever their menus, adverts and scripts; trees of few such pages aren't used.
What is never part of an article (menus, forms, adverts and so on, by element or by a whole class name) is cut
out beforehand, and if a page marks its article, only that is read. Class names never cut the page's body; nor what holds an article. But
an article inside a branch named for comments, adverts or teasers is one of these, unless the page has no other article and it holds more text than all
outside of it. All else is left to the importance.

Hosts are aggregated with partial sums before the shuffle; the nodes to be cut are a few numbers per host.

Defined results: a null or empty html has an empty text; a page whose host can't be read belongs to the host "";
repeated rows are read each; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.frames import map_batches
from evenkeel.session import materialise

#: A tree is used from so many distinct pages on; branches of less importance are cut.
MIN_PAGES = 5
MIN_IMPORTANCE = 0.25
#: How much the arrangements of a node count against what lies below it.
GAMMA = 0.9

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_CLASS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = ("script", "style", "template", "noscript", "textarea", "title", "iframe", "svg", "math", "xmp")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements inside a line: they are no branches of their own.
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
_CUT_ELEMENTS = {"nav", "aside", "footer", "form", "button", "select", "dialog", "menu", "head", "object", "canvas", "audio", "video", "fieldset"}
_CUT_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login share sharing social related recommended "
    "recommendations comment comments disqus discussion replies reply respond form search widget pagination pager toolbar skip complementary contentinfo".split()
)
#: Of these, names of what readers and other pages say: an article inside is no article of the page.
_OTHERS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo related recommended recommendations comment comments disqus discussion "
    "replies reply respond".split()
)
#: Elements that their class never cuts.
_KEPT_ELEMENTS = {"html", "body", "main", "article"}
_CLOSED_BY = {
    "p": set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li td th tr dt dd".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option", "optgroup"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"},
}


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _node(above: int, name: str, marks: str) -> int:
    return xxhash.xxh64_intdigest(f"{name} {marks}", above & (2**64 - 1)) - 2**63


def _marks(attributes: str) -> tuple[str, set[str], bool]:
    """The classes of an element as text, without numbers; its classes, ids and roles, without a number at their end; whether its role is main."""
    if not attributes:
        return "", set(), False
    found = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _CLASS.finditer(attributes)]
    names = {re.sub(r"[-_]?\d+\Z", "", w) for _, v in found for w in v.split()}
    main = any(k == "role" and "main" in v.split() for k, v in found)
    return " ".join(sorted(re.sub(r"\d+", "", v) for k, v in found if k != "id")), names, main


class Page:
    """blocks: (node, text, within an article) in page order; nodes: node -> (node above, names of its children)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, bool]] = []
        self.nodes: dict[int, tuple[int | None, list[str]]] = {0: (None, [])}
        self.above: list[int] = [0]
        self._read(source)

    def _read(self, source: str) -> None:
        # name, node, cut by element, place of the article, branches cut by class
        stack: list[tuple[str, int, bool, int | None, tuple[int, ...]]] = [("", 0, False, None, ())]
        parts: list[str] = []
        found: list[tuple[int, str, int | None, tuple[int, ...]]] = []
        regions: dict[int, tuple[int, ...]] = {}  # of articles: the branches cut by class that they lie in
        others: set[int] = set()  # branches of comments and teasers
        holding: set[int] = set()  # other branches cut by class that hold an article
        at, n = 0, len(source)

        def flush():
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                parts.clear()
                _, node, cut, article, classed = stack[-1]
                if text and not cut:
                    found.append((node, text, article, classed))

        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                parts.append(source[at:])
                break
            if m.start() > at:
                parts.append(source[at : m.start()])
            at, name = m.end(), (m[2] or "").lower()
            if not name or (name in _INLINE and name not in _RAW):
                continue
            flush()
            if name in ("br", "hr") or name in _VOID:
                continue
            if m[1]:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), None)
                if k is not None:
                    del stack[k:]
                continue
            if name in _RAW:
                if name in ("svg", "math") and m[3].endswith("/"):
                    continue
                end = re.compile(f"</{name}", re.I).search(source, at)
                close = source.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else n
                continue
            while len(stack) > 1 and name in _CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            if m[3].endswith("/") and name not in ("p", "div"):
                continue
            marks, names, main = _marks(m[3])
            _, node, cut, article, classed = stack[-1]
            main = main or name in ("article", "main")
            # An article in a branch that is cut inside another article is one of its own.
            if main and (article is None or regions[article] != classed):
                article = at
                regions[article] = classed
            if main and not cut and others.isdisjoint(classed):
                holding.update(classed)
            cut = cut or name in _CUT_ELEMENTS or name == "header" and article is None
            if not main and name not in _KEPT_ELEMENTS and names & _CUT_WORDS:
                classed = (*classed, at)
                if names & _OTHERS:
                    others.add(at)
            below = _node(node, name, marks)
            self.nodes[node][1].append(name)
            self.nodes.setdefault(below, (node, []))
            stack.append((name, below, cut, article, classed))
        flush()
        left = {classed: tuple(k for k in classed if k not in holding) for _, _, _, classed in found}
        self._choose([(*f[:3], left[f[3]]) for f in found], {k: tuple(x for x in v if x not in holding) for k, v in regions.items()})

    def _choose(self, found: list[tuple[int, str, int | None, tuple[int, ...]]], regions: dict[int, tuple[int, ...]]) -> None:
        """Keep the blocks outside branches that classes cut.

        An article in such a branch is a comment or a teaser, unless no other article has text and it has more than all
        that lies outside of articles: then the largest of them is the page's article.
        """
        clean = sum(len(t) for _, t, article, classed in found if article is not None and not classed)
        plain = sum(len(t) for _, t, article, classed in found if article is None and not classed)
        mass: dict[int, int] = {}
        for _, t, article, classed in found:
            if article is not None and classed == regions[article]:
                mass[article] = mass.get(article, 0) + len(t)
        chosen = None if clean else max((k for k in mass if regions[k]), key=lambda k: (mass[k], -k), default=None)
        if chosen is not None and mass[chosen] <= plain:
            chosen = None
        freed = set(regions[chosen]) if chosen is not None else set()
        self.blocks = [
            (node, t, article is not None and (chosen is None or article == chosen))
            for node, t, article, classed in found
            if freed.issuperset(classed)
        ]

    def own(self) -> list[tuple[int, str, bool]]:
        """The article's blocks, or all where none is marked."""
        return [b for b in self.blocks if b[2]] or self.blocks

    def text(self, cut: set[int]) -> str:
        """The article's blocks but those of branches to be cut."""
        gone: dict[int | None, bool] = {None: False}

        def out(node: int) -> bool:
            chain = []
            while node not in gone:
                chain.append(node)
                if node in cut:
                    gone[node] = True
                    break
                node = self.nodes[node][0]
            for x in reversed(chain):
                gone[x] = gone.get(x, False) or gone[node]
                node = x
            return gone[node]

        return " ".join(t for node, t, _ in self.own() if not out(node))


def _style_rows(pages: DataFrame, by_article: bool) -> DataFrame:
    """What each page shows at each style node: (host, page, node, above, source, style, texts).

    A page is the hash of its source or, by article, of the texts that are read of it: so copies share it though their sources differ.
    """

    def take(batches):
        for b in batches:
            for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not source:
                    continue
                page, where = Page(source), host(url)
                own = xxhash.xxh64_intdigest(source) - 2**63
                same = xxhash.xxh64_intdigest("\n".join(t for _, t, _ in page.own())) - 2**63 if by_article else own
                texts: dict[int, set[int]] = {}
                for node, t, _ in page.blocks:
                    texts.setdefault(node, set()).add(xxhash.xxh64_intdigest(t) - 2**63)
                n, nodes = len(page.nodes), list(page.nodes)
                yield [
                    [where] * n, [same] * n, nodes, [page.nodes[x][0] for x in nodes], [own] * n,
                    [xxhash.xxh64_intdigest(" ".join(page.nodes[x][1])) - 2**63 for x in nodes], [sorted(texts.get(x, ())) for x in nodes],
                ]

    kind = "host string, page bigint, node bigint, above bigint, source bigint, style bigint, texts array<bigint>"
    return map_batches(pages, take, kind)


def importance(pages: DataFrame, by_article: bool = False) -> DataFrame:
    """(host, node, above, pages, own, importance) of every style node of hosts with enough distinct pages.

    A text found on c of a node's m pages has the entropy log c / log m; a leaf is as important as its texts are
    spread thinly: 1 less their mean entropy. An inner node adds the entropy of its arrangements.
    Pages are told apart by their sources or, by article, by the texts that are read of them.
    """
    rows = _style_rows(pages, by_article)
    # A page counts once at each node, as its copy of the least source has it; copies fall together before the shuffle.
    once = rows.groupBy("host", "page", "node", "above").agg(F.min(F.struct("source", "style", "texts")).alias("x"))
    shown = F.concat(
        F.array(F.struct(F.lit("style").alias("kind"), F.col("x.style").alias("feature"))),
        F.transform("x.texts", lambda t: F.struct(F.lit("text").alias("kind"), t.alias("feature"))),
    )
    each = once.select("host", "node", "above", F.inline(shown)).groupBy("host", "node", "above", "kind", "feature").agg(F.count("*").alias("c"))
    each = materialise(each, "styles")
    styles = each.where("kind = 'style'").groupBy("host", "node").agg(
        F.sum("c").alias("m"), F.count("*").alias("l"), F.expr("sum(c * ln(c))").alias("clogc")
    )
    texts = each.where("kind = 'text'").groupBy("host", "node").agg(F.expr("sum(ln(c))").alias("logs"), F.count("*").alias("texts"))
    nodes = each.where("kind = 'style'").select("host", "node", "above").distinct()
    out = nodes.join(styles, ["host", "node"]).join(texts, ["host", "node"], "left").where(f"m >= {MIN_PAGES}")
    # Entropy of arrangements to the base of the number of pages; 0 if all are arranged alike.
    spread = F.expr("(ln(m) - clogc / m) / ln(m)")
    leaf = F.expr("case when texts > 0 then greatest(0D, 1 - logs / texts / ln(m)) end")
    out = materialise(out.select("host", "node", "above", "m", "l", spread.alias("spread"), leaf.alias("leaf")), "nodes")
    below = out.groupBy("host", "above").agg(F.avg("leaf").alias("below")).withColumnRenamed("above", "node")
    share = F.pow(F.lit(GAMMA), F.col("l"))
    inner = F.when(F.col("below").isNotNull(), (1 - share) * F.col("spread") + share * F.col("below"))
    return out.join(below, ["host", "node"], "left").withColumn("importance", F.greatest("leaf", inner)).drop("below")


def branches_to_cut(pages: DataFrame, least: float = MIN_IMPORTANCE) -> DataFrame:
    """(host, cut): the branches of too little importance, by host."""
    low = importance(pages, by_article=True).where(F.col("importance") < least)
    return low.groupBy("host").agg(F.collect_set("node").alias("cut"))


def main_text(pages: DataFrame, least: float = MIN_IMPORTANCE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html)."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    cut = materialise(branches_to_cut(pages.select("url", "html"), least), "cut")

    def name(batches):
        for b in batches:
            yield [*b.columns, [host(u) for u in b.column(1).to_pylist()]]

    hosted = map_batches(pages, name, "page_id bigint, url string, html string, host string")
    joined = hosted.join(cut, "host", "left").select("page_id", "url", "html", "cut")

    def take(batches):
        for b in batches:
            texts = [
                Page(source).text(set(own or ())) if source else ""
                for source, own in zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            ]
            yield [b.column(0), b.column(1), texts, [len(t) for t in texts]]

    return map_batches(joined, take, "page_id bigint, url string, text string, n_chars bigint")
