"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: each element's path (the steps from the root: tag, class names, place among namesakes where a
container has no class) and each whole text under its path. Over the pages of a host every token has an occurrence
vector, how often each page has it. Tokens of equal vectors form an equivalence class; one is valid that is large and
frequent enough, split where its tokens lie in slots of different classes, and the valid ones nest into the host's
template (:func:`deduce`). Then every page gives its main text from the template's slots:

- The main region is found by walking down the template from the root, each time to the element whose slots hold most
  text that is neither a link's nor the template's, as long as one holds more than half and no heading stays behind.
  Articles and main elements count more on the way; where it ends, the articles inside are the region if there are any.
- In the region, texts of the template go, as do slots of links and elements that say by tag, role or name that they are
  menus, headers, footers, sidebars, notices, adverts, forms or comments. A name says so only when all its parts are
  known words (``related-posts``, but not ``related-work``); what encloses the region is never such an aside.
- A page that lacks the region of its host is read as a host of its own.

Vectors are never built: a token's vector is known by its number of pages, its total and hashes of (page, count) that
aggregate before the shuffle; and a host's frequent tokens are no more than those of two pages. So a host may have any
share of all pages.

Defined cases: null html counts as empty and gives an empty text; a null or odd url is host ''; repeated rows count as
pages of their own; on a host of fewer than :data:`CLASS_PAGES` pages texts are never of the template (a copied article
would be), elements are; a page of which the template leaves nothing is a copy of others and keeps its region; a tag or
comment that never ends takes the rest of the page, as the HTML standard says; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import map_arrow, spread_join, stored

#: A class is valid from so many tokens on, when its tokens are on at least this share of a host's pages; a text must be on so many pages.
CLASS_TOKENS, SUPPORT, CLASS_PAGES = 2, 0.6, 5
#: A slot with such a share of its text in links is one of links; a tag that marks the text makes an element's text count so much more.
LINKS, MARKED = 0.6, 4

# Names that say what an element is.
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
#: Elements that end before the next of these.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Containers that are told apart by their place where they have no class.
PLACED = frozenset(["div", "section", "table", "tr", "td", "center", "ul"])
ASIDE_TAGS = frozenset(
    "head script style nav header footer aside button select option textarea noscript iframe svg template object canvas audio video dialog menu title xmp noembed noframes math map".split()
)
ASIDE_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar"])
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments respond replies reply disqus sidebar breadcrumb breadcrumbs menu nav navbar navigation footer masthead widget widgets pagination pager toolbar header skip".split()
)
#: Of those, what holds other texts than the page's own.
OTHERS = frozenset("ad ads adv advert adverts advertisement advertising adsense related recommended comment comments respond replies reply disqus".split())
#: What may stand beside one of those in a name.
NEUTRAL = frozenset(
    "area articles bar block box button buttons bottom container form global group inner item items left link links list main outer page panel post posts primary reader readers right row secondary section site stories thread top unit user users wrap wrapper".split()
)

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
#: The next end of a tag, or value in quotes; the group is its closing quote, empty where there is none.
_END = re.compile(r">|=\s*(?:\"[^\"]*(\"?)|'[^']*('?))")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_NAMES = re.compile(r"[_-]+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
_ROOT = 0


def _attributes(raw: str) -> dict[str, str]:
    """All attributes, so that nothing inside a value is taken for one; the first of a name counts."""
    found: dict[str, str] = {}
    if raw.strip("/ \t\r\n"):
        for m in _ATTR.finditer(raw):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _is_content(tag: str, attr: dict[str, str]) -> bool:
    return tag in ("article", "main") or attr.get("role", "").lower() == "main"


def _aside(tag: str, attr: dict[str, str]) -> int:
    """0 no aside, 1 one that may be a wrapper of the text (a form, most names), 2 one that never is."""
    role = attr.get("role", "").lower()
    if tag in ASIDE_TAGS or role in ASIDE_ROLES:
        return 2
    if "hidden" in attr or attr.get("aria-hidden", "").lower() == "true" or "display:none" in attr.get("style", "").replace(" ", "").lower():
        return 2
    found = int(tag == "form" or role == "form")
    if tag in ("html", "body", "main"):
        return found
    for name in f"{attr.get('class', '')} {attr.get('id', '')}".lower().split():
        parts = {x for x in _NAMES.split(name) if x and not x.isdigit()}
        if not parts.isdisjoint(ASIDE_NAMES) and parts <= ASIDE_NAMES | NEUTRAL:
            found = max(found, 1 if parts.isdisjoint(OTHERS) else 2)
    return found


@dataclass
class Element:
    """A path of the page: its hash, its parent's place in the list, tag (``main`` also for its role) and what kind of aside it says that it is."""

    hash: int
    parent: int
    tag: str
    aside: int
    n: int = 0
    chars: int = 0
    links: int = 0


@dataclass
class Page:
    """Paths in the order of their first element, the root first, and blocks (text, place of its path, characters in links)."""

    paths: list[Element] = field(default_factory=lambda: [Element(_ROOT, -1, "#", 0, 1)])
    blocks: list[tuple[str, int, int]] = field(default_factory=list)


def _hashed(text: str, parent: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), parent & (2**64 - 1)) - (1 << 63)


def _tag_end(html: str, at: int) -> int:
    """Behind the tag whose name ends at ``at``; behind the page if it never ends."""
    while m := _END.search(html, at):
        if m[0] == ">":
            return m.end()
        if not (m[1] or m[2]):
            break
        at = m.end()
    return len(html) + 1


def read(html: str) -> Page:
    """One pass, linear in the page."""
    page, known = Page(), {}
    paths = page.paths
    stack: list[tuple[str, int, int, bool]] = []  # tag, path and links outside, inline
    opened: dict[str, int] = defaultdict(int)
    blocks: list[int] = []  # where in it the block elements are
    namesakes: list[dict[str, int]] = [{}]  # of each open block, how many of each step it has
    parts, linked = [], 0
    path, links = 0, 0  # where we are, and how many open links enclose it

    def flush():
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                page.blocks.append((text, path, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close():
        nonlocal path, links
        tag, path, links, inline = stack.pop()
        opened[tag] -= 1
        if not inline:
            namesakes.pop()
            blocks.pop()

    end, n = 0, len(html)
    while end < n:
        m = _OPEN.search(html, end)
        begin = m.start() if m else n
        if begin > end:
            parts.append(unescape(html[end:begin]))
            if links:
                linked += len(parts[-1].strip())
        if not m:
            break
        if m[3]:
            end = html.find("-->", m.end())
            end = end + 3 if end >= 0 else n
            continue
        if m[2] is None:
            end = html.find(">", m.end())
            end = end + 1 if end >= 0 else n
            continue
        tag, end = m[2].lower(), _tag_end(html, m.end())
        if end > n:
            break
        if tag == "br":
            parts.append(" ")
        elif m[1]:
            if opened[tag]:
                while True:
                    name, _, _, inline = stack[-1]
                    if not inline:
                        flush()
                    close()
                    if name == tag:
                        break
        else:
            attr = _attributes(html[m.end() : end - 1])
            aside = _aside(tag, attr)
            inline = tag in INLINE and not aside
            if not inline:
                flush()
            if tag in VOID:
                continue
            if tag in RAW:
                shut = re.compile(f"</{tag}[\\s/>]", re.I).search(html, end)
                end = _tag_end(html, shut.end() - 1) if shut else n
                continue
            # A paragraph ends before a block, an item before the next.
            while tag not in INLINE and blocks and (stack[blocks[-1]][0] == "p" or stack[blocks[-1]][0] in CLOSED_BY.get(tag, ())):
                for _ in range(len(stack) - blocks[-1]):
                    close()
            if not inline:
                blocks.append(len(stack))
            stack.append((tag, path, links, inline))
            opened[tag] += 1
            if inline:
                links += tag == "a"
            else:
                step = ".".join([tag, *sorted(set(attr.get("class", "").split()))]) + "!" * aside
                if step == tag and tag in PLACED:
                    own = namesakes[-1]
                    own[tag] = own.get(tag, 0) + 1
                    step = f"{tag}[{own[tag]}]"
                namesakes.append({})
                if (path, step) not in known:
                    known[path, step] = len(paths)
                    name = "main" if tag != "article" and _is_content(tag, attr) else tag
                    paths.append(Element(_hashed(step, paths[path].hash), path, name, aside))
                path = known[path, step]
                paths[path].n += 1
    flush()
    for text, at, inside in page.blocks:
        paths[at].chars += len(text)
        paths[at].links += inside
    for e in reversed(paths):  # a path comes after its parent
        if e.parent >= 0:
            paths[e.parent].chars += e.chars
            paths[e.parent].links += e.links
    return page


#: A token over the pages of a host: hash, parent's hash (none for the root), tag ('' for a text), aside, pages, total, vector, characters, those in links.
Token = tuple[int, int | None, str, int, int, int, int, int, int]


@dataclass
class Template:
    """classes: (tokens, outer class or -1); texts of the template; the region's paths; paths in it that are slots of links."""

    classes: list[tuple[frozenset[int], int]] = field(default_factory=list)
    texts: frozenset[int] = frozenset()
    region: frozenset[int] = frozenset()
    dropped: frozenset[int] = frozenset()


def deduce(of: int, tokens: list[Token]) -> Template:
    """The template of a host of ``of`` pages from its frequent tokens."""
    tokens = [t for t in tokens if t[4] >= SUPPORT * of and (t[2] or t[4] >= CLASS_PAGES)]
    info = {t[0]: t for t in tokens}
    parent = {t[0]: t[1] for t in tokens}
    alike = defaultdict(list)
    for t in tokens:
        alike[t[4:7]].append(t[0])
    rough = {x: k for k, members in alike.items() if len(members) >= CLASS_TOKENS for x in members}

    def slot(x: int) -> int | None:
        """The nearest token above that is of another class: it opens the slot that x lies in."""
        k, up = rough[x], parent[x]
        while up in info and rough.get(up, k) == k:
            up = parent[up]
        return up if up in info else None

    split = defaultdict(list)
    for x, k in rough.items():
        split[k, slot(x)].append(x)
    valid = {k: frozenset(v) for k, v in split.items() if len(v) >= CLASS_TOKENS}
    number = {k: i for i, k in enumerate(valid)}
    own = {x: number[k] for k, v in valid.items() for x in v}
    classes = [(members, own.get(k[1], -1) if k[1] is not None else -1) for k, members in valid.items()]
    texts = frozenset(x for x in own if not info[x][2])
    # What the slots hold.
    score = {x: t[7] - t[8] for x, t in info.items() if t[2]}
    for x in texts:
        up = parent[x]
        while up in score:
            score[up] -= info[x][7] - info[x][8]
            up = parent[up]
    kids = defaultdict(list)
    for x in score:
        kids[parent[x]].append(x)
    order, todo = [], [x for x in score if parent[x] not in score]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += kids[x]
    marks: dict[int, int] = {}  # 2 an article inside or here, 1 a main element
    heads: dict[int, bool] = {}
    for x in reversed(order):
        tag = info[x][2]
        marks[x] = max([2 if tag == "article" else int(tag == "main"), *(marks[k] for k in kids[x] if info[k][3] < 2)])
        heads[x] = tag in HEADINGS and score[x] > 0 or any(heads[k] for k in kids[x])
    at, whole = _ROOT, score.get(_ROOT, 0)

    def closed(x: int) -> bool:
        """An aside, unless it may be a wrapper and encloses an article or main element or most of all text."""
        return info[x][3] == 2 or info[x][3] == 1 and not marks[x] and 2 * score[x] < whole

    while info[at][2] != "article":
        open_ = [k for k in kids[at] if not closed(k) and score[k] > 0]
        if not open_:
            break
        weight = {k: score[k] * (MARKED if marks[k] else 1) for k in open_}
        best = max(open_, key=lambda k: (weight[k], k))
        rest = score[at] - sum(score[k] for k in kids[at] if closed(k)) - score[best]
        if weight[best] <= rest or (not marks[best] and any(heads[k] for k in open_ if k != best)):
            break
        at = best

    def outermost(tag: str) -> list[int]:
        found, todo = [], [at]
        while todo:
            x = todo.pop()
            if info[x][2] == tag:
                found.append(x)
            else:
                todo += [k for k in kids[x] if not closed(k)]
        return found

    region = outermost("article") or outermost("main") or [at]
    inside, todo = [], [k for x in region for k in kids[x]]
    while todo:
        x = todo.pop()
        inside.append(x)
        todo += kids[x]
    dropped = [x for x in inside if info[x][2] not in HEADINGS and info[x][7] > 0 and info[x][8] >= LINKS * info[x][7]]
    return Template(classes, texts, frozenset(region), frozenset(dropped))


def tokens_of(page: Page) -> list[tuple[int, int | None, str, int, int, int, int]]:
    """hash, parent's hash (none for the root), tag ('' for a text), aside, n, characters, those in links: once for each token of a page."""
    out = [(e.hash, page.paths[e.parent].hash if e.parent >= 0 else None, e.tag, e.aside, e.n, e.chars, e.links) for e in page.paths]
    texts: dict[tuple[int, int], list[int]] = {}
    for text, at, links in page.blocks:
        up = page.paths[at].hash
        held = texts.setdefault((_hashed("|" + text, up), up), [0, 0, 0])
        held[0] += 1
        held[1] += len(text)
        held[2] += links
    return out + [(h, up, "", 0, *held) for (h, up), held in texts.items()]


def _own_template(page: Page) -> Template:
    return deduce(1, [(h, up, tag, aside, 1, n, 0, chars, links) for h, up, tag, aside, n, chars, links in tokens_of(page)])


def _slots(page: Page, t: Template) -> list[tuple[str, int, int]]:
    """The blocks of the page that lie in the region and in none of its asides and slots of links."""
    state = []  # 0 outside, 1 in the region, 2 in something of it that goes
    for e in page.paths:
        up = state[e.parent] if e.parent >= 0 else 0
        if e.hash in t.region and up == 0:
            state.append(1)
        else:
            state.append(2 if up == 1 and (e.aside or e.hash in t.dropped) else up)
    return [b for b in page.blocks if state[b[1]] == 1]


def main_text(html: str | None, template: Template | None = None) -> str:
    page = read(html or "")
    template = template or Template()
    slots = _slots(page, template)
    if not slots and page.blocks:
        own = _own_template(page)
        slots = _slots(page, own)
    kept = [b for b in slots if _hashed("|" + b[0], page.paths[b[1]].hash) not in template.texts] if template.texts else slots
    return "\n".join(b[0] for b in kept or slots)


def occurrences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """host, token, parent, tag, aside, n, chars, links, one row for each page and token; the root, token 0, is on every page."""

    def run(cols, n):
        names = ("_page", "host", "token", "parent", "tag", "aside", "n", "chars", "links")
        rows = []
        for page, host, html in zip(cols["_page"], cols["host"], cols["html"], strict=True):
            rows += [(page, host, *t) for t in tokens_of(read(html or ""))]
        return dict(zip(names, zip(*rows, strict=True), strict=True))

    rows = pages.select(F.xxhash64(key, "url", "html").alias("_page"), host_of().alias("host"), "html")
    return map_arrow(rows, run, "_page bigint, host string, token bigint, parent bigint, tag string, aside int, n bigint, chars bigint, links bigint", "html")


def host_of():
    return F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))


def templates(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """host, pages, and the template of each host: texts, region, dropped (arrays of token hashes), classes (number and outer class of each token)."""
    place = F.xxhash64("_page", "n")
    seen = occurrences(pages, key).groupBy("host", "token").agg(
        F.count("*").alias("pages"),
        F.sum("n").alias("total"),
        F.xxhash64(F.bit_xor(place), F.sum(F.pmod(place, F.lit(1 << 31)))).alias("vector"),
        F.min("parent").alias("parent"),
        F.min("tag").alias("tag"),
        F.min("aside").alias("aside"),
        F.sum("chars").alias("chars"),
        F.sum("links").alias("links"),
    )
    seen = stored(seen.where((F.col("tag") != "") | (F.col("pages") >= CLASS_PAGES)), "tokens")
    hosts = seen.where(F.col("token") == _ROOT).select("host", F.col("pages").alias("of"))
    often = seen.join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("of"))
    # A host's frequent tokens are at most those of its average page, divided by the support.
    lists = often.groupBy("host", "of").agg(F.collect_list(F.struct("token", "parent", "tag", "aside", "pages", "total", "vector", "chars", "links")).alias("tokens"))

    def run(cols, n):
        made = [deduce(of, [tuple(t.values()) for t in ts]) for of, ts in zip(cols["of"], cols["tokens"], strict=True)]
        out = {"host": cols["host"], "pages": cols["of"]}
        for name in ("texts", "region", "dropped"):
            out[name] = [sorted(getattr(t, name)) for t in made]
        out["classes"] = [[{"number": i, "outer": outer, "token": x} for i, (members, outer) in enumerate(t.classes) for x in sorted(members)] for t in made]
        return out

    return map_arrow(lists, run, "host string, pages bigint, texts array<bigint>, region array<bigint>, dropped array<bigint>, classes array<struct<number: int, outer: int, token: bigint>>")


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, text, n_chars for every page."""
    made = stored(templates(pages, key).select(F.col("host").alias("_host"), "pages", F.struct("texts", "region", "dropped").alias("_template")), "templates")

    def run(cols, n):
        text = [main_text(h, Template([], *(frozenset(t[x]) for x in ("texts", "region", "dropped"))) if t else None) for h, t in zip(cols["html"], cols["_template"], strict=True)]
        return {key: cols[key], "url": cols["url"], "text": text, "n_chars": pa.array(np.array([len(t) for t in text], np.int64))}

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(key, "url", "html", host_of().alias("_host"))
    joined = spread_join(rows, made, "_host", "pages", "left").select(key, "url", "html", "_template")
    return map_arrow(joined, run, f"`{key}` {kind}, url string, text string, n_chars bigint", "html")
