"""Main text of web pages by wrappers inferred for each host.

A page becomes a token stream: one token for each tag (name, class, id, role) and one
for each text.  A label that recurs among siblings folds into a repeated group, so a
page's shape is short whatever its length.  The wrapper of a host is a union-free
regular expression over such shapes.  It starts as one shape and is aligned with the
next: equal tokens match, texts become slots, a mismatch that one side explains by
repeats becomes a repeated group, and what only one side has becomes optional.

Alignment runs over the distinct shapes of a host only (counted by a map-side
combined aggregation, so a host with a third of all pages sends each shape once a
task).  Shapes are folded in salted parts first, then the parts of a host.

Every slot of the wrapper knows its path, how much text, in and outside links, the
host's pages have there, and whether they all have the same.  An element is
boilerplate by tag (script, style, nav, header, ...), role, or a whole class token or id
that is a sure name (sidebar, cookie-notice, comments, ...); any other word of a class
or id (search, discussion, legal, ...) counts only where the wrapper shows link-heavy
or repeated text at that place.  Modifiers (with-sidebar) and the ids of headings,
paragraphs and items tell nothing.  The main region is the wrapper's outermost article
and main elements, if they hold most of the text, else the whole page; from there
it goes inward only while all that it leaves behind is boilerplate or slots of links
or of repeated text.  Every page of the host is then read through that region.

Defined cases: a null html counts as empty and has no text; a null or unusable url
is a host of its own (empty name); broken markup, unclosed elements and cut-off
pages are read as far as they go; repeated rows give equal rows; other columns are
carried, those named like a result column are replaced.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_size, checkpoint, chunks

#: parts that a host's shapes are dealt into before its wrapper is folded
PARTS = 16
#: share of a host's pages with one and the same text in a slot (three pages at least) that makes it repeated text
REPEATED, REPEATED_PAGES = 0.5, 3
#: element of a shape that counts the pages
PAGE = "#page"
#: between the labels of a path
SEP = "\x1f"
#: elements that are parts of a text
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEAVES = {"p", "li", "td", "th", "dt", "dd", "pre", "blockquote", *HEADINGS}
#: hosts whose wrappers are broadcast at most; more are joined by shuffle
BROADCAST_HOSTS = 20_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""([\w:-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|([\w:-]+)""")
SPACE = re.compile(r"\s+")
# fixed values: HTML's elements by kind
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
            "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
JUNK_TAGS = {"nav", "header", "footer", "aside", "form", "script", "style", "head", "noscript", "template", "iframe", "button", "select", "textarea",
             "svg", "menu", "dialog", "object", "canvas", "fieldset", "option", "input", "title"}
JUNK_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
JUNK_NAMES = {"nav", "navbar", "navigation", "menu", "submenu", "topbar", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "footer", "foot",
              "sidebar", "side", "aside", "rail", "widget", "widgets", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay",
              "alert", "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "promo", "promoted", "promotion", "sponsor", "sponsored",
              "form", "newsletter", "subscribe", "subscription", "signup", "login", "search", "comment", "comments", "respond", "reply", "replies",
              "disqus", "discussion", "share", "sharing", "social", "related", "recommended", "pagination", "pager", "legal", "copyright", "disclaimer"}
#: of these, what names boilerplate if it is a whole class token or id; the others need evidence of the wrapper
SURE_NAMES = {"nav", "navbar", "navigation", "submenu", "topbar", "breadcrumb", "breadcrumbs", "masthead", "footer", "sidebar", "widget", "widgets", "cookie",
              "cookies", "gdpr", "popup", "modal", "ad", "ads", "advert", "adverts", "advertisement", "adsense", "promo", "sponsored", "newsletter", "signup",
              "comment", "comments", "disqus", "pagination", "pager"}
#: of all, what an article or main element may be named if it isn't the page's own
CARD_NAMES = {"comment", "comments", "reply", "replies", "related", "recommended", "promo", "promoted", "sponsor", "sponsored", "ad", "ads", "advert",
              "advertisement", "teaser", "notice", "widget"}
#: words beside such names that change nothing, and first words of tokens that speak of another element
NEUTRAL = {"top", "bottom", "site", "primary", "secondary", "main", "global", "mobile", "links", "list", "item"}
MODIFIERS = {"with", "without", "has", "no", "not", "is", "hide", "show"}
OUT = {"text": T.StringType(), "n_chars": T.LongType()}


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _names(token: str) -> list[str]:
    """The words of a class token or id: split at anything but letters, and at a change of case."""
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", token)]


def _label(tag: str, attrs: str) -> str:
    """Tag with what tells its part in the page: class, id (digits out) and role."""
    if not attrs.strip(" /\t\r\n"):
        return tag
    got = {}
    for m in ATTR.finditer(attrs):
        if m[1] and (k := m[1].lower()) in ("class", "id", "role"):
            got.setdefault(k, re.sub(r"\d+", "", entities.unescape(m[2].strip("\"'"))))
        elif (m[1] or m[3]).lower() == "hidden":
            got["hidden"] = "1"
    return tag + "".join(f" {k}={got[k]}" for k in sorted(got))


_JUNK: dict[str, int] = {}


def junk_kind(label: str) -> int:
    """2: boilerplate; 1: only where the wrapper shows link-heavy or repeated text; else 0."""
    known = _JUNK.get(label)
    if known is None:
        tag, *rest = label.split(" ", 1)
        got = dict(re.findall(r"(class|id|role|hidden)=(.*?)(?= (?:class|id|role|hidden)=|$)", rest[0])) if rest else {}
        known = 2 if tag in JUNK_TAGS or got.get("role", "").lower() in JUNK_ROLES or "hidden" in got else 0
        if not known and tag not in ("html", "body"):
            card = tag in ("article", "main")
            names, sure = (CARD_NAMES, CARD_NAMES - {"notice"}) if card else (JUNK_NAMES, SURE_NAMES)
            if tag in INLINE:
                sure = sure - {"comment", "comments"}  # code listings mark comments
            for kind in ("class",) if tag in LEAVES or tag in INLINE else ("class", "id"):
                for token in got.get(kind, "").split():
                    words = _names(token)
                    if names.isdisjoint(words) or words[0] in MODIFIERS:
                        continue
                    whole = not sure.isdisjoint(words) and (names | NEUTRAL).issuperset(words)
                    known = max(known, 2 if whole and (kind == "class" or tag != "section") else 1)
        if len(_JUNK) > 50_000:
            _JUNK.clear()
        _JUNK[label] = known
    return known


def is_junk(label: str) -> bool:
    return junk_kind(label) == 2


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """(path of labels, text of the block with white space folded, characters of it in links), in page order."""
    path: list[str] = []  # labels of the open block elements
    tags: list[str] = []  # their tag names
    open_inline: list[str] = []  # inline elements that are open and junk, as labels
    text: list[str] = []
    linked, in_link, at, end = 0, 0, 0, len(page)

    def flush() -> Iterator[tuple[tuple[str, ...], str, int]]:
        nonlocal linked
        joined = SPACE.sub(" ", "".join(text)).strip()
        text.clear()
        n, linked = linked, 0
        if joined:
            yield tuple(path), joined, min(n, len(joined))

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not open_inline:
            piece = entities.unescape(piece)
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in INLINE:
                if open_inline and open_inline[-1].split(" ", 1)[0] == tag:
                    open_inline.pop()
            elif tag in tags:
                yield from flush()
                k = len(tags) - 1 - tags[::-1].index(tag)
                del tags[k:], path[k:]
                open_inline.clear()
            else:
                yield from flush()
            continue
        if tag in RAW:
            close = RAW_END[tag].search(page, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "hr":
            yield from flush()
            continue
        if tag in VOID:
            continue
        label = _label(tag, m[3])
        if tag in INLINE:
            if tag == "a":
                in_link += 1
            if open_inline or is_junk(label):
                open_inline.append(label)
            continue
        yield from flush()
        in_link = 0
        open_inline.clear()
        if tags and tag in CLOSES_P and tags[-1] == "p":
            tags.pop(), path.pop()
        if tag in ("li", "dt", "dd", "option", "tr", "td", "th") and tags and (tags[-1] == tag or {tag, tags[-1]} in ({"dt", "dd"}, {"td", "th"})):
            tags.pop(), path.pop()
        tags.append(tag)
        path.append(label)
    yield from flush()


# A shape or wrapper is a list of nodes: ["E", label, nodes] elements, ["T", ...] text slots and groups ["+", nodes]
# (repeated) or ["?", nodes] (optional).  A slot has sums over its texts: characters outside and in links, texts,
# and hashes and squares of hashes, which tell whether all texts are the same.
EMPTY = [0, 0, 0, 0, 0]


def _slot(text: str, linked: int) -> list:
    h = zlib.crc32(text.encode("utf-8", "surrogatepass")) & 0x7FFF
    return ["T", len(text) - linked, linked, 1, h, h * h]


def _fold(nodes: list) -> list:
    """A label that recurs among siblings becomes one repeated group at its first place; texts become one slot."""
    out: list = []
    place: dict[str, int] = {}
    for n in nodes:
        at = place.setdefault(n[1] if n[0] == "E" else "", len(out))
        if at == len(out):
            out.append(n)
        else:
            old = out[at][1][0] if out[at][0] == "+" else out[at]
            out[at] = _merge(old, n) if n[0] == "T" else ["+", [_merge(old, n)]]
    return out


def _same(a: list, b: list) -> bool:
    """Two nodes that one expression can stand for: elements of one label, or two texts."""
    if a[0] in "+?" and b[0] in "+?":
        return _same(a[1][0], b[1][0])
    if a[0] in "+?":
        return _same(a[1][0], b)
    if b[0] in "+?":
        return _same(a, b[1][0])
    return a[0] == b[0] and (a[0] == "T" or a[1] == b[1])


def _merge(a: list, b: list) -> list:
    """The node for both: slots add up their text, repeats and options of either side stay."""
    if a[0] in "+?" or b[0] in "+?":
        kind = "+" if "+" in (a[0], b[0]) else "?"
        x, y = (n[1][0] if n[0] in "+?" else n for n in (a, b))
        return [kind, [_merge(x, y)]]
    if a[0] == "T":
        return ["T", *(x + y for x, y in zip(a[1:], b[1:], strict=True))]
    return ["E", a[1], align(a[2], b[2])]


def align(a: list, b: list) -> list:
    """The union-free expression for both lists of nodes: a longest common run of matching nodes, all else optional."""
    if len(a) == len(b) and all(map(_same, a, b)):
        return [_merge(x, y) for x, y in zip(a, b, strict=True)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _same(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out: list = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and _same(a[i], b[j]):
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j >= len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append(a[i] if a[i][0] in "+?" else ["?", [a[i]]])
            i += 1
        else:
            out.append(b[j] if b[j][0] in "+?" else ["?", [b[j]]])
            j += 1
    return _squeeze(out)


def _squeeze(nodes: list) -> list:
    """Neighbours that one repeated group explains (two options or repeats of one label) become that group."""
    out: list = []
    for n in nodes:
        if out and n[0] in "+?" and out[-1][0] in "+?" and _same(out[-1], n):
            out[-1] = ["+", [_merge(out[-1][1][0], n[1][0])]]
        else:
            out.append(n)
    return out


def shape(page: str) -> list:
    """The folded tree of a page: elements with their blocks, repeats folded at every level."""
    root: list = ["E", "", []]
    stack, path = [root], ()
    for p, text, linked in blocks(page):
        same = 0
        while same < min(len(p), len(path)) and p[same] == path[same]:
            same += 1
        # a block that follows on the same path starts a new sibling, unless it goes deeper
        if len(path) and p == path:
            same = len(p) - 1
        del stack[same + 1 :]
        for label in p[same:]:
            node: list = ["E", label, []]
            stack[-1][2].append(node)
            stack.append(node)
        stack[-1][2].append(_slot(text, linked))
        path = p
    return [["E", PAGE, [["T", 0, 0, 1, 0, 0]]], *_folded(root)[2]]


def _folded(node: list) -> list:
    return ["E", node[1], _fold([_folded(c) if c[0] == "E" else c for c in node[2]])] if node[0] == "E" else node


def _bare(nodes: list) -> list:
    """A shape without text lengths, to count equal shapes."""
    return [["T", *EMPTY] if n[0] == "T" else ["E", n[1], _bare(n[2])] if n[0] == "E" else [n[0], _bare(n[1])] for n in nodes]


def _slots(nodes: list) -> list[list[int]]:
    out: list[list[int]] = []
    for n in nodes:
        out += [n[1:]] if n[0] == "T" else _slots(n[2] if n[0] == "E" else n[1])
    return out


def _filled(nodes: list, values: Iterator[list[int]]) -> list:
    """A bare shape with its slots' sums put back."""
    out = []
    for n in nodes:
        if n[0] == "T":
            out.append(["T", *map(int, next(values))])
        else:
            out.append(["E", n[1], _filled(n[2], values)] if n[0] == "E" else [n[0], _filled(n[1], values)])
    return out


def _kids(nodes: list) -> list:
    return [x for n in nodes for x in (_kids(n[1]) if n[0] in "+?" else [n])]


def _repeats(wrapper: list) -> int:
    """Texts that a slot needs to be repeated text, if they are all the same; 0: the host's pages are copies."""
    def varies(nodes: list) -> bool:
        return any(n[1] > 0 and n[3] * n[5] != n[4] ** 2 if n[0] == "T" else n[1] != PAGE and not is_junk(n[1]) and varies(_kids(n[2])) for n in _kids(nodes))

    pages = sum(n[2][0][3] for n in wrapper if n[0] == "E" and n[1] == PAGE)
    return max(REPEATED_PAGES, math.ceil(REPEATED * pages)) if varies(wrapper) else 0


def _sums(nodes: list, repeats: int, heading: bool = False) -> tuple[int, int, int]:
    """Text outside links, in links, and outside links in slots whose texts differ, of what isn't boilerplate; a
    heading's links count as outside."""
    plain = linked = own = 0
    for n in _kids(nodes):
        if n[0] == "T":
            same = repeats and n[3] >= repeats and n[3] * n[5] == n[4] ** 2
            p, k = (n[1] + n[2], 0) if heading else n[1:3]
            o = 0 if same else p
        elif is_junk(n[1]):
            continue
        else:
            p, k, o = _sums(n[2], repeats, heading or n[1].split(" ", 1)[0] in HEADINGS)
        plain, linked, own = plain + p, linked + k, own + o
    return plain, linked, own


def _boilerplate(n: list, repeats: int) -> bool:
    """A node without text of its own: all of it boilerplate by name, in links for the most part, or repeated."""
    plain, linked, own = _sums([n], repeats)
    return linked > plain or not own


def dropped(wrapper: list) -> list[str]:
    """Paths of the elements, none with a main element inside or most of the text, that a word of their name and their text tell as boilerplate."""
    repeats = _repeats(wrapper)
    at: dict[tuple[str, ...], list] = {}

    def walk(nodes: list, path: tuple[str, ...]) -> bool:
        held = False
        for n in _kids(nodes):
            if n[0] == "E" and not is_junk(n[1]):
                own = (*path, n[1])
                holds = walk(n[2], own)
                if junk_kind(n[1]) and not holds:
                    at.setdefault(own, []).append(n)
                held = held or holds or is_main(n[1])
        return held

    walk(wrapper, ())
    total = _sums(wrapper, repeats)[0]
    out = []
    for path, nodes in at.items():
        plain, linked, own = _sums(nodes, repeats)
        if 2 * plain < max(total, 1) and (linked > plain or not own):
            out.append(SEP.join(path))
    return sorted(out)


def _without(nodes: list, paths: set[str], path: tuple[str, ...] = ()) -> list:
    """The nodes without the elements of these paths."""
    return [["E", n[1], _without(n[2], paths, own)] if n[0] == "E" else n
            for n in _kids(nodes) if n[0] == "T" or SEP.join(own := (*path, n[1])) not in paths]


def region(wrapper: list) -> list[str]:
    """Paths of the elements that hold the main text, each as its labels joined by SEP; empty: the whole page."""
    repeats = _repeats(wrapper)
    wrapper = _without(wrapper, set(dropped(wrapper)))
    found: dict[tuple[str, ...], tuple[int, list]] = {}  # outermost articles and main elements with their text and nodes

    def walk(nodes: list, path: tuple[str, ...], junk: bool, want: bool) -> None:
        for n in _kids(nodes):
            if n[0] != "E":
                continue
            own, bad = (*path, n[1]), is_junk(n[1])
            if is_main(n[1]) and not bad and junk == want and (p := _sums(n[2], repeats)[0]):
                old = found.get(own, (0, []))
                found[own] = old[0] + p, old[1] + n[2]
            else:
                walk(n[2], own, junk or bad, want)

    total = _sums(wrapper, repeats)[0]
    for inside in (False, True):  # outside boilerplate first; what is in it must be more than all that is outside
        found.clear()
        walk(wrapper, (), False, inside)
        held = sum(p for p, _ in found.values())
        if found and (held > total if inside else 2 * held >= total):
            break
        found.clear()
    out = []
    for path, nodes in [(p, n) for p, (_, n) in found.items()] or [((), wrapper)]:
        # go inward while nothing but boilerplate is left behind
        while True:
            rich = [k for k in _kids(nodes) if not _boilerplate(k, repeats)]
            labels = {k[1] for k in rich if k[0] == "E"}
            if len(labels) != 1 or any(k[0] == "T" for k in rich) or (label := labels.pop()).split(" ", 1)[0] in LEAVES:
                break
            path, nodes = (*path, label), [x for k in rich for x in k[2]]
        out.append(path)
    return [SEP.join(p) for p in out] if () not in out else []


def is_main(label: str) -> bool:
    """An article or a main element."""
    tag, _, rest = label.partition(" ")
    return tag in ("article", "main") or "role=article" in rest or "role=main" in rest


def main_text(page: str | None, inside: list[str], without: list[str]) -> str:
    """The blocks of the region that aren't boilerplate, joined by one space; of the whole page if it lacks the region."""
    drop = set(without)
    found, anywhere = [], []
    paths = [tuple(p.split(SEP)) for p in inside]
    for path, text, _ in blocks(page or ""):
        if drop and any(junk_kind(x) == 1 and SEP.join(path[: k + 1]) in drop for k, x in enumerate(path)):
            continue
        n = max((len(p) for p in paths if path[: len(p)] == p), default=0)
        if n:  # what wraps the region doesn't tell what is in it
            if not any(map(is_junk, path[n:])):
                found.append(text)
        elif not any(map(is_junk, path)):
            anywhere.append(text)
            if any(p[-1] in path and is_main(p[-1]) for p in paths):
                found.append(text)
    return " ".join(found or anywhere)


def shapes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, shape, slots): each host's distinct shapes, and the sums of their slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                seen: dict[tuple[str, str], list[list[int]]] = {}
                for h, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    s = shape(page or "")
                    slots = _slots(s)
                    if (old := seen.get(key := (h, json.dumps(_bare(s), separators=(",", ":"))))) is not None:
                        slots = [[x + y for x, y in zip(a, b, strict=True)] for a, b in zip(old, slots, strict=True)]
                    seen[key] = slots
                yield pa.RecordBatch.from_pydict({
                    "host": pa.array([k[0] for k in seen], pa.string()), "shape": pa.array([k[1] for k in seen], pa.string()),
                    "slots": pa.array(list(seen.values()), pa.list_(pa.list_(pa.int64())))})

    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, shape string, slots array<array<long>>")
    # equal shapes meet in one row, with their slots summed
    at = rows.select("host", "shape", F.posexplode("slots").alias("i", "n")).groupBy("host", "shape", "i").agg(
        F.array(*[F.sum(F.col("n")[k]) for k in range(len(EMPTY))]).alias("n"))
    slots = F.array_sort(F.collect_list(F.struct("i", "n")))
    return at.groupBy("host", "shape").agg(F.transform(slots, lambda x: x["n"]).alias("slots"))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, region, dropped): a host's union-free expression as JSON, the paths of its main region and of boilerplate known by its text."""
    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shape")
        out: list | None = None
        for s, slots in zip(rows["shape"], rows["slots"], strict=True):
            nodes = _filled(json.loads(s), iter(slots))
            out = nodes if out is None else align(out, nodes)
        out = out or []
        return pd.DataFrame({"host": [key[0]], "shape": [json.dumps(_bare(out), separators=(",", ":"))], "slots": [_slots(out)]})

    kind = "host string, shape string, slots array<array<long>>"
    parts = shapes(pages, url, html).withColumn("part", F.pmod(F.xxhash64("shape"), F.lit(PARTS)))
    partial = parts.groupBy("host", "part").applyInPandas(fold, kind)
    whole = partial.groupBy("host").applyInPandas(fold, kind)

    @F.pandas_udf("region array<string>, dropped array<string>")
    def region_of(shape: pd.Series, slots: pd.Series) -> pd.DataFrame:
        nodes = [_filled(json.loads(s), iter(n)) for s, n in zip(shape, slots, strict=True)]
        return pd.DataFrame({"region": [region(n) for n in nodes], "dropped": [dropped(n) for n in nodes]})

    return whole.select("host", F.col("shape").alias("wrapper"), region_of("shape", "slots").alias("r")).select("host", "wrapper", "r.region", "r.dropped")


def extract(pages: DataFrame, url: str = "url", html: str = "html", limit: int = BROADCAST_HOSTS) -> DataFrame:
    """The pages (without html) with text and n_chars."""
    kept = [c for c in pages.columns if c not in OUT and c != html]
    schema = T.StructType([*(pages.schema[c] for c in kept), *(T.StructField(n, t) for n, t in OUT.items())])
    regions = checkpoint(wrappers(pages, url, html).select(F.col("host").alias("_host"), F.col("region").alias("_region"), F.col("dropped").alias("_dropped")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_html"):
                texts = [main_text(p, r or [], d or []) for p, r, d in zip(*(part.column(c).to_pylist() for c in ("_html", "_region", "_dropped")), strict=True)]
                arrays = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, *OUT])

    rows = pages.select(*kept, F.col(html).alias("_html"), host_of(F.col(url)).alias("_host"))
    rows = rows.join(by_size(regions, regions.count(), limit), "_host", "left")
    return rows.select(*kept, "_html", "_region", "_dropped").mapInArrow(run, schema)
