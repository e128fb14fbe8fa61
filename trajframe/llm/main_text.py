"""Operator 4, main text by equivalence classes of template tokens.

A page is read into elements and text blocks.  Its tokens are the paths of its
elements (tags with their classes) and its text blocks.  For every token of a host
two sums over its pages, of hashes of (page, number of occurrences), stand for its
occurrence vector; tokens with equal vectors are one class.  Pages with the same
article (or, without one, the same text) count as one page.  A class is valid when
it occurs on ``SUPPORT`` pages or more and holds ``SIZE`` tokens or more; classes
nest by the paths that enclose their tokens.  A text block of a valid class is
template when it is on at least half of the pages that hold its enclosing path (in
an article: the article's path), or, outside articles, when a path is of its class,
for the pages then are a type that always has it.  What is left are the slots.

The main slot of a page is its article elements; without them its main element;
without that all slots.  Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
go by their elements, roles and class names (fixed lists below).  Inside an article
or main element a name counts when it is a whole class and says enough (``SURE``), or
when the element holds no heading and is short or mostly links.  Text of an
article that belongs to the template goes as well, but not its headings, and not
when more than half of the article would go: near copies stay whole.

A line break inside a block counts as white space.  Defined cases: null or empty
html gives an empty text; a page without host is judged alone, as is a host with
fewer than ``SUPPORT`` pages; repeated rows are pages of their own."""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SUPPORT, SIZE = 4, 3
HOSTS, LEAST_PAGES = 1000, 1000
#: Kinds of tokens, the last two bits of their hash: element path, text block outside articles, text block of an article.
PATH, OUTER, INNER = 0, 1, 2

# Fixed value lists: elements by their part in a page, names that mark boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg canvas object textarea math".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSED_BY_BLOCK = {"p"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
OUT = set("head title nav footer aside form button select menu dialog label option".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog form menu menubar".split())
NAMES = set("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted banner sidebar sidenav menu nav navbar "
            "navigation breadcrumb breadcrumbs header footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
            "subscription signup comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations "
            "pagination pager widget widgets toolbar login search skip".split())
#: Names that say enough in an article; the others count there for an element that is short or mostly links.
SURE = set("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored cookie cookies consent gdpr popup newsletter "
           "comment comments commentlist disqus reply replies respond breadcrumb breadcrumbs pagination pager sidebar sidenav navbar".split())
#: As an id, only these; other ids name what a section is about.
REMARKS = set("comments commentlist disqus respond".split())
SHORT = 200
INSIDE = set("article main body html".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w:.-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Za-z]+")


class Page:
    """Elements as parallel lists (``tag, parent, names, last``) and text blocks ``(element, text)``.
    ``names`` are the runs of letters in classes and ids, ``whole`` the listed names that
    are a class and ``ids`` those that are an id."""

    def __init__(self, html: str | None):
        self.tag, self.parent, self.names, self.roles, self.last = ["html"], [-1], [frozenset()], [frozenset()], [0]
        self.whole, self.ids = [frozenset()], [frozenset()]
        self.blocks: list[tuple[int, str, int]] = []          # element, text, characters in links
        stack, run, run_at, links = [0], [], 0, 0
        html = html or ""
        at, n = 0, len(html)

        def flush():
            nonlocal run, links
            if run:
                text = " ".join(entities.unescape("".join(run)).split())
                if text:
                    self.blocks.append((run_at, text, links))
            run, links = [], 0

        def silent():
            """In an inline element that is boilerplate."""
            content = any(self.tag[e] in ("article", "main") or "main" in self.roles[e] for e in stack)
            for e in reversed(stack):
                if self.tag[e] in BLOCK:
                    return False
                if self.tag[e] in OUT or (self.whole[e] & SURE if content else self.names[e] & NAMES) or self.roles[e] & ROLES:
                    return True

        def close(depth):
            while len(stack) > depth:
                self.last[stack.pop()] = len(self.tag) - 1

        while at < n:
            m = TAG.search(html, at)
            end = m.start() if m else n
            if end > at and not silent():
                if not run:
                    run_at = next(e for e in reversed(stack) if self.tag[e] in BLOCK)
                run.append(html[at:end])
                if any(self.tag[e] == "a" for e in stack[-3:]):
                    links += end - at
            if not m:
                break
            at = m.end()
            closing, name, rest = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
            if not name:
                continue
            name = name.lower()
            if name == "br":
                run.append(" ")
            if name in BLOCK:
                flush()
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] == name:
                        close(depth)
                        break
                continue
            if name in RAW and not rest.endswith("/"):
                done = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = done.end() if done else n
                continue
            if name in BLOCK:
                for depth in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[depth]]
                    if tag in CLOSED_BY_BLOCK:
                        close(depth)
                        break
                    if tag in BLOCK:
                        break
            if name in SIBLINGS:
                for depth in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[depth]]
                    if tag in SCOPES[name]:
                        break
                    if tag in SIBLINGS[name]:
                        close(depth)
                        break
            if name in VOID or rest.endswith("/") or name in ("html", "body") and len(stack) > 1 and name in (self.tag[e] for e in stack):
                continue
            names, roles, whole, ids = set(), set(), set(), set()
            for key, *values in ATTRIBUTE.findall(rest):
                key, value = key.lower(), "".join(values).lower()
                (roles if key == "role" else names).update(PART.findall(value))
                if key in ("class", "id"):
                    (whole if key == "class" else ids).update(NAMES.intersection(value.split()))
            self.whole.append(frozenset(whole)), self.ids.append(frozenset(ids))
            self.tag.append(name), self.parent.append(stack[-1])
            self.names.append(frozenset(names)), self.roles.append(frozenset(roles)), self.last.append(len(self.tag) - 1)
            if name != "html":
                stack.append(len(self.tag) - 1)
            else:
                self.parent[-1] = 0
                stack.append(len(self.tag) - 1)
        flush()
        close(1)
        self.last[0] = len(self.tag) - 1
        self._judge()

    def _judge(self):
        """Which elements are out, and which lie in an article."""
        n = len(self.tag)
        holds, heads = np.zeros(n, bool), np.zeros(n, bool)    # an article or main element inside, a heading inside
        for e in range(n - 1, 0, -1):
            if holds[e] or self.tag[e] in ("article", "main"):
                holds[self.parent[e]] = True
            if heads[e] or self.tag[e] in HEADINGS:
                heads[self.parent[e]] = True
        size, link = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for e, text, links in self.blocks:
            size[e + 1] += len(text)
            link[e + 1] += links
        size, link = np.cumsum(size).tolist(), np.cumsum(link).tolist()
        self.out, self.article, self.path = [False] * n, [False] * n, [""] * n
        content = [False] * n                                  # in an article or main element
        for e in range(n):
            p, tag = self.parent[e], self.tag[e]
            up_out, up_article, up_content = (self.out[p], self.article[p], content[p]) if p >= 0 else (False, False, False)
            if up_content:
                chars = size[self.last[e] + 1] - size[e]
                linked = 2 * (link[self.last[e] + 1] - link[e]) > chars
                named = bool(self.whole[e] & SURE or self.ids[e] & REMARKS) or not heads[e] and (
                    bool(self.whole[e] | self.ids[e]) and chars <= SHORT or bool(self.names[e] & NAMES) and linked)
            else:
                named = bool(self.names[e] & NAMES)
            marked = not holds[e] and tag not in INSIDE - {"article"} and (named and tag not in HEADINGS or bool(self.roles[e] & ROLES))
            own = tag in OUT or marked or tag == "header" and not up_article and not holds[e] and not (up_content and heads[e])
            self.out[e] = up_out or own
            self.article[e] = not self.out[e] and (up_article or tag == "article")
            content[e] = up_content or tag in ("article", "main") or "main" in self.roles[e]
            self.path[e] = (self.path[p] + "/" if p >= 0 else "") + tag + "".join("." + x for x in sorted(self.names[e]))

    def tokens(self) -> dict[tuple[int, int], int]:
        """Occurrences of element paths and of text blocks, by hash and the hash of
        the path that encloses them (for all of an article, the article's)."""
        found: dict[tuple[int, int], int] = {}
        for e, path in enumerate(self.path):
            key = path_key(path), path_key(self.path[max(self.parent[e], 0)])
            found[key] = found.get(key, 0) + 1
        for e, text, _ in self.blocks:
            if not self.out[e]:
                key = self.block_key(e, text), path_key(self.path[self.slot(e)])
                found[key] = found.get(key, 0) + 1
        return found

    def slot(self, e: int) -> int:
        """The outermost article around an element, or the element itself."""
        at = e
        while self.article[at] and self.article[self.parent[at]]:
            at = self.parent[at]
        return at

    def block_key(self, e: int, text: str) -> int:
        return block_key(self.path[self.slot(e)], text, self.article[e])

    def copy(self) -> int:
        """Equal for pages with the same article (without one: the same text)."""
        kept = [(e, text) for e, text, _ in self.blocks if not self.out[e]]
        inside = [text for e, text in kept if self.article[e]]
        return xxhash.xxh3_64_intdigest("\n".join(inside or [text for _, text in kept])) >> 1

    def main(self, template: frozenset[int]) -> list[str]:
        """Text blocks of the main slot in page order."""
        kept = [(e, text, link) for e, text, link in self.blocks if not self.out[e]]
        inside = [(e, text) for e, text, _ in kept if self.article[e]]
        if inside:
            slots = [text for e, text in inside if self.tag[e] in HEADINGS or self.block_key(e, text) not in template]
            whole = [text for _, text in inside]
            return slots if 2 * sum(map(len, slots)) >= sum(map(len, whole)) else whole
        kept = [(e, text) for e, text, _ in kept if self.block_key(e, text) not in template]
        roots = [e for e in range(len(self.tag)) if not self.out[e] and (self.tag[e] == "main" or "main" in self.roles[e])]
        chosen = [text for e, text in kept if any(r <= e <= self.last[r] for r in roots)]
        return chosen or [text for _, text in kept]


def path_key(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) >> 3 << 2 | PATH


def block_key(path: str, text: str, article: bool) -> int:
    return xxhash.xxh3_64_intdigest(path + "\t" + text) >> 3 << 2 | (INNER if article else OUTER)


def _tokens(batches):
    for batch in batches:
        host, copy, key, up, count = [], [], [], [], []
        for h, html in zip(*(batch.column(c).to_pylist() for c in ("host", "html"))):
            page = Page(html)
            found = page.tokens()
            host += [h] * len(found)
            copy += [page.copy()] * len(found)
            key += [k for k, _ in found]
            up += [u for _, u in found]
            count += found.values()
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(copy, pa.int64()), pa.array(key, pa.int64()), pa.array(up, pa.int64()), pa.array(count, pa.int32())],
                                         ["host", "copy", "token", "up", "n"])


def _main(batches):
    for batch in batches:
        out = []
        for html, template in zip(batch.column("html").to_pylist(), batch.column("template").to_numpy(zero_copy_only=False)):
            page, held = Page(html), frozenset()
            if template is not None:
                keys = np.array([page.block_key(e, text) for e, text, _ in page.blocks], np.int64)
                held = frozenset(keys[np.isin(keys, template)].tolist())
            out.append("\n\n".join(page.main(held)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def templates(pages: DataFrame) -> DataFrame:
    """``host, template``: hashes of the text blocks that valid classes make template."""
    # copies of a page are one, and so are tokens they share; a token lies in one enclosing path
    token = (pages.mapInArrow(_tokens, "host string, copy long, token long, up long, n int")
             .groupBy("host", "token", "copy").agg(F.max("n").alias("n"), F.min("up").alias("up")))
    part = lambda seed: F.sum(F.pmod(F.xxhash64("copy", "n", F.lit(seed)), F.lit(2**31)))
    vectors = cut(token.groupBy("host", "token").agg(F.count(F.lit(1)).alias("support"), part(1).alias("s1"), part(2).alias("s2"), F.min("up").alias("up"))
                  .where(F.col("support") >= SUPPORT), "vectors")
    # a block is judged within the pages that hold its enclosing path; one outside articles also
    # by the paths of its class, for they mark a type of page that always has it
    around = vectors.select("host", F.col("token").alias("up"), F.col("support").alias("within"))
    placed = vectors.join(around, ["host", "up"])
    classes = (placed.groupBy("host", "support", "s1", "s2").agg(F.collect_list(F.struct("token", "within")).alias("tokens"))
               .where(F.size("tokens") >= SIZE))
    kind = lambda t: t["token"].bitwiseAND(3)
    typed = F.exists("tokens", lambda t: kind(t) == PATH)
    held = F.filter("tokens", lambda t: (kind(t) != PATH) & ((F.col("support") * 2 >= t["within"]) | (kind(t) == OUTER) & typed))
    return classes.select("host", held["token"].alias("tokens")).groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("template"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row a page: ``page_id, url, text, n_chars``."""
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    pages = pages.select("page_id", "url", "html", F.lower(F.when(host != "", host)).alias("host"), F.xxhash64("page_id", "url").alias("page"))
    hosted = pages.where("host is not null")
    known = templates(hosted.select("host", "html"))
    # a host with more than a HOSTS-th of all pages is spread over several keys; there are fewer than HOSTS such hosts
    sizes = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("_n"))
    share = F.greatest(F.lit(LEAST_PAGES), F.ceil(sizes.agg(F.sum("_n")).scalar() / HOSTS))
    large = F.broadcast(sizes.where(F.col("_n") > share).select("host", F.ceil(F.col("_n") / share).alias("_k")))
    keys = F.coalesce("_k", F.lit(1))
    known = known.join(large, "host", "left").withColumn("_key", F.explode(F.sequence(F.lit(0).cast("long"), keys - 1)))
    pages = pages.join(large, "host", "left").withColumn("_key", F.pmod("page", keys))
    return (pages.join(known.select("host", "_key", "template"), ["host", "_key"], "left").select("page_id", "url", "html", "template")
            .mapInArrow(_main, "page_id long, url string, text string, n_chars long"))
