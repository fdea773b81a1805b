"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative;
one linear scan finds the contiguous region of greatest sum. Elements that
never hold an article (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments, scripts, styles) count as one tag with all they hold,
so their words are neither scored nor returned. A form, a role or a class is no
proof: such an element is read like any other when it holds the page's article
or most of its words, and one whose name only has a telling word among others
costs a penalty.

The weights come from labelled pages: pages whose markup names the one element
that holds the article. They teach how strongly each tag speaks against being
inside an article, which classes of elements hold boilerplate, and the scale
between tags and words.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eraloom.llm.common import hash_sample

# Pages that the weights are learned from.
TRAIN_PAGES = 4_000
# Scales of tags against words that are tried; the first of the best is taken.
SCALES = (2.0, 1.0, 4.0, 0.5, 8.0, 16.0)
# An element's class holds boilerplate if it is on this share of the labelled pages and never in an article.
BOILER_SHARE = 0.02

# Elements of the markup language, and usual names of what is not the article.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style noscript template iframe svg math canvas object nav aside footer form button select textarea menu dialog title noembed noframes".split())
HOLDERS = ("article", "main")
NAMED = re.compile(
    r"(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"nav\w*|menu|breadcrumbs?|sidebar|widget|related|recommend\w*|share|sharing|social|comments?|disqus|replies|footer|masthead|copyright|pagination|pager|skip|toolbar)",
    re.I,
)
# Words that may stand beside those without changing what the name says, and words that make it a modifier of something else.
NEUTRAL = frozenset("site page post entry global top bottom left right primary secondary inner outer wrap wrapper container box bar block area panel list item items link links button buttons icon icons posts articles stories group slot unit form trail".split())
MODIFIERS = frozenset("has with no without not non hide".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Key and penalty (before scaling) of an element whose name has one of those words among others.
SUSPECT, SUSPECT_PENALTY = "*named", 5.0
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())

_markup = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_attribute = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(frozen=True)
class Weights:
    tags: dict[str, float] = field(default_factory=dict)  # penalty of each tag before scaling
    boiler: frozenset[str] = frozenset()  # element.class of boilerplate
    scale: float = SCALES[0]


def _keys(name: str, attributes: str) -> tuple[list[str], dict[str, str]]:
    """The element's name and its name with each class; its attributes."""
    found = {a.lower(): html.unescape(b or c or d) for a, b, c, d in _attribute.findall(attributes)} if attributes.strip(" /") else {}
    return [name, *(f"{name}.{c.lower()}" for c in found.get("class", "").split())], found


def _named(name: str, found: dict[str, str], held: int) -> int:
    """2 if the element's class or id is a usual name of boilerplate, 1 if it has a word of one among others, else 0.

    ``has-sidebar``, ``no-comments`` and the like tell of something else. Ids
    of headings, and of sections inside the holding element, are made from
    their titles and tell nothing.
    """
    names = [(x, False) for x in found.get("class", "").split()]
    if name not in HEADINGS and not (held and name == "section"):
        names += [(x, True) for x in found.get("id", "").split()]
    most = 0
    for x, by_id in names:
        words = [w for w in re.split(r"[_-]+", x.lower()) if w]
        hits = [bool(NAMED.fullmatch(w)) for w in words]
        if not any(hits) or not MODIFIERS.isdisjoint(words[: hits.index(True)]):
            continue
        if all(h or w in NEUTRAL or w.isdigit() for h, w in zip(hits, words)):
            return 2
        most = max(most, int(not (by_id and held)))
    return most


def _pieces(page: str) -> list[tuple[str, str, str]]:
    """('text', text, ''), ('open', name, attributes), ('empty', name, attributes), ('close', name, '') and ('raw', name, '') in page order."""
    out, at = [], 0
    while at < len(page):
        m = _markup.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            out.append(("text", page[at:stop], ""))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            out.append(("close", name, ""))
        elif name in VOID or m[3].endswith("/"):
            out.append(("empty", name, m[3]))
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            out.append(("raw", name, ""))
        else:
            out.append(("open", name, m[3]))
    return out


class _Extents:
    """Where a page's elements end, and what they hold."""

    def __init__(self, pieces: list[tuple[str, str, str]]):
        self.ends = [len(pieces)] * len(pieces)
        self.holders: list[int] = []
        self.words = [0]  # of the pieces before, without elements that never hold an article
        opened: dict[str, list[int]] = {}
        for i, (what, x, _) in enumerate(pieces):
            if what == "open":
                opened.setdefault(x, []).append(i)
            elif what == "close" and opened.get(x):
                self.ends[opened[x].pop()] = i
        until = -1
        for i, (what, x, _) in enumerate(pieces):
            if what == "open":
                if x in HOLDERS:
                    self.holders.append(i)
                if x in NEVER and x != "form":
                    until = max(until, self.ends[i])
            self.words.append(self.words[-1] + (len(x.split()) if what == "text" and i > until else 0))
        self.mains = [i for i in self.holders if pieces[i][1] == "main"]

    def essential(self, i: int) -> bool:
        """Whether element ``i`` holds a main or all holders of the page, or most of the words while no holder is apart from it."""
        end = self.ends[i]
        inside = [h for h in self.holders if i < h < end]
        if inside:
            return len(inside) == len(self.holders) or any(i < h < end for h in self.mains)
        apart = any(h > end or self.ends[h] < i for h in self.holders)
        return not apart and 2 * (self.words[min(end, len(self.words) - 1)] - self.words[i]) > self.words[-1]


def tokens(page: str | None, boiler: frozenset[str] = frozenset()) -> Iterator[tuple[str, object]]:
    """('text', text), ('open', keys), ('close', name) and ('skip', keys) for boilerplate elements as a whole, in page order.

    A page header is boilerplate, a header inside the holding element is not.
    """
    pieces = _pieces(page or "")
    extents: _Extents | None = None
    i, held = 0, 0
    while i < len(pieces):
        what, name, attributes = pieces[i]
        i += 1
        if what == "text":
            yield "text", name
            continue
        if what == "raw":
            yield "skip", [name]
            continue
        if what == "close":
            held -= name in HOLDERS and held > 0
            yield "close", name
            continue
        keys, found = _keys(name, attributes)
        named = _named(name, found, held) if name not in ("html", "body", *HOLDERS) and ("class" in found or "id" in found) else 0
        bad = name in NEVER and name != "form" or name == "header" and not held or "hidden" in found or found.get("aria-hidden") == "true"
        if not bad and (
            name == "form" or found.get("role", "").lower() in ROLES or named == 2
            or name not in ("html", "body", *HOLDERS) and any(k in boiler for k in keys[1:])
        ):
            if what == "open":
                extents = extents or _Extents(pieces)
            bad = what == "empty" or not extents.essential(i - 1)
        if bad:
            yield "skip", keys
            if what == "open":
                extents = extents or _Extents(pieces)
                i = extents.ends[i - 1] + 1
            continue
        held += name in HOLDERS
        yield "open", [*keys, SUSPECT] if named == 1 else keys


def best_region(page: str | None, w: Weights) -> tuple[list[tuple[str, object]], int, int]:
    """The page's tokens and the region [from, to) of greatest score; the earliest, shortest one among equals."""
    found = list(tokens(page, w.boiler))
    best, span, total, since = 0.0, (0, 0), 0.0, 0
    get = w.tags.get
    for i, (what, x) in enumerate(found):
        if what == "text":
            total += len(html.unescape(x).split())
            if total > best:
                best, span = total, (since, i + 1)
        else:
            total -= w.scale * (get("/" + x, 0.5) if what == "close" else max(get(k, SUSPECT_PENALTY if k == SUSPECT else 0.5) for k in x))
        if total <= 0:
            total, since = 0.0, i + 1
    return found, *span


def main_text(page: str | None, w: Weights) -> str:
    """Text of the best region: blocks with single spaces inside, joined by two line ends."""
    found, a, b = best_region(page, w)
    blocks, block = [], []
    for what, x in [*found[a:b], ("close", "body")]:
        if what == "text":
            block.append(x)
        elif what == "open" and x[0] == "br":
            block.append(" ")
        elif (x if what == "close" else x[0]) in BLOCKS:
            blocks.append("".join(block))
            block = []
    joined = [" ".join(html.unescape(t).split()) for t in blocks]
    return "\n\n".join(t for t in joined if t)


def _labelled(page: str | None) -> tuple[str, list[tuple[str, object]], int, int] | None:
    """The holding element's name, the page's tokens and the place of its tags, if exactly one element is named as holder."""
    found = list(tokens(page))
    for name in HOLDERS:
        opens = [i for i, (what, x) in enumerate(found) if what == "open" and x[0] == name]
        closes = [i for i, (what, x) in enumerate(found) if what == "close" and x == name]
        if len(opens) == 1 and len(closes) == 1 and opens[0] < closes[0]:
            return name, found, opens[0], closes[0]
    return None


def learn(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Weights:
    """Weights from about ``train_pages`` pages, chosen by the hash of their id; defaults if none of them is labelled.

    The driver gets counts by tag and class of the sample.
    """
    sample = hash_sample(pages.select("page_id", "html").where("html is not null"), "page_id", train_pages).select("html")

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                if (labelled := _labelled(page)) is None:
                    continue
                _, found, a, b = labelled
                seen["", "pages"] += 1
                open_: list[list[str]] = []
                for i, (what, x) in enumerate(found):
                    where = "in" if a < i < b else "out"
                    if what == "close":
                        seen["/" + x, where] += 1
                        if any(k[0] == x for k in open_):
                            while open_.pop()[0] != x:
                                pass
                    elif what != "text":
                        for k in x:
                            seen[k, where] += 1
                        if i == a:
                            for k in {k for keys in open_ for k in keys}:
                                seen[k, "around"] += 1
                        if what == "open" and x[0] not in VOID:
                            open_.append(x)
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in rows], pa.string()), pa.array([x for (_, x), _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["key", "place", "n"])

    rows = sample.mapInArrow(count, "key string, place string, n long").groupBy("key", "place").agg(F.sum("n").alias("n")).collect()
    n = {(r["key"], r["place"]): r["n"] for r in rows}
    total = n.pop(("", "pages"), 0)
    if not total:
        return Weights()
    get = lambda k, place: n.get((k, place), 0)
    keys = {k for k, _ in n} - {SUSPECT}
    tags = {k: 0.05 + max(0.0, math.log((get(k, "out") + 1) / (get(k, "in") + 1))) for k in keys}
    boiler = frozenset(k for k in keys if "." in k and not get(k, "in") and not get(k, "around") and get(k, "out") >= max(3, BOILER_SHARE * total) and k.split(".")[0] not in HOLDERS)

    def exact(batches):
        hits: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                if (labelled := _labelled(page)) is None:
                    continue
                _, found, a, b = labelled
                inside = [x.strip() for what, x in found[a:b] if what == "text" and x.strip()]
                for s in SCALES:
                    got, c, d = best_region(page, Weights(tags, boiler, s))
                    hits[s] += [x.strip() for what, x in got[c:d] if what == "text" and x.strip()] == inside
        yield pa.RecordBatch.from_arrays([pa.array(list(hits), pa.float64()), pa.array([int(v) for v in hits.values()], pa.int64())], ["scale", "n"])

    won = {r["scale"]: r["n"] for r in sample.mapInArrow(exact, "scale double, n long").groupBy("scale").agg(F.sum("n").alias("n")).collect()}
    return Weights(tags, boiler, max(SCALES, key=lambda s: won.get(s, 0)))


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``url``, ``text`` and ``n_chars`` (code points).

    The whole html is read. Null, empty and textless pages give an empty text;
    unclosed elements and cut-off tags end where the page ends. Every row is
    kept, repeated ones too; other columns are ignored.
    """
    w = weights or learn(pages)

    @F.pandas_udf("string")
    def text(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series([main_text(x, w) for x in s], dtype=object)

    return pages.select("page_id", "url", text("html").alias("text")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
