"""HTML main text by wrappers: union-free regular expressions, inferred by aligning the token streams of a host's pages.

A page is a stream of block tags and text slots. Inside a page, neighbouring parts of one shape are folded into a
repeated group. The streams of a host are aligned one after the other with the wrapper so far: what matches is kept, a
part that only one side has becomes an optional group, parts that repeat become a repeated group, and texts become
slots. What the texts of an aligned position have in common decides about it: a position with one text on all pages is the
template's, and of the others those in the article's element hold the article. Every stream is told which of its slots
those are, and they are read from every page.

Equal streams are counted before they are aligned, so a host's wrapper costs as many alignments as the host has shapes
of pages, not pages. Streams of a large host are aligned in parts, and the parts' wrappers with each other.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

# HTML's elements by their part in a page.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: An open element that ends where one of the others begins.
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option"}, "head": {"body"},
    "p": BLOCKS - {"body", "head", "html", "button", "option", "legend", "caption", "title"},
}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "head", "title", "fieldset"}
BOILERPLATE_NAMES = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "masthead", "footer", "sidebar", "aside", "widget",
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion",
    "popup", "modal", "overlay", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "newsletter", "subscribe",
    "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations",
    "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "pagination", "pager", "toolbar",
    "skip", "search", "complementary", "contentinfo", "reactions",
}
ARTICLE, MAIN_NAMES = {"article", "main"}, {"articlebody"}
#: A class or id that begins or ends with one of these says what a layout has, not what the element is.
FIRST_MODIFIERS = {"has", "have", "no", "not", "with", "without", "hide", "show", "is", "on", "off"}
LAST_MODIFIERS = {"open", "opened", "closed", "on", "off", "enabled", "disabled", "visible", "hidden", "active", "fixed", "sticky"}
#: Marked as no article for good; whatever else is marked stays if it holds most of a host's varying text.
NEVER_ARTICLE = ("head", "title", "nav", "menu", "button", "select", "dialog")

SLOT = "#"
#: Deeper elements belong to their ancestor's part and path, but for the first that is marked as article or as none.
DEEPEST = 60
#: Distinct streams that are aligned in one group; a host with more is aligned in parts, and the parts with each other.
STREAMS = 2_000
#: The streams' slots of all hosts up to this size are broadcast to the pages; larger tables meet them by a shuffle.
BROADCAST_BYTES = 16 << 20
#: A text is a template's if it is the same on more distinct pages than this. Copies of a page count once.
COPIES = 2


@dataclass
class Part:
    """A slot, an element or a group of parts (no name), and how often it occurs: "", "?", "+" or "*".

    A slot knows whose texts it stands for: a page's blocks by number, or the slots that were aligned to it.
    """

    name: str
    often: str = ""
    parts: list[Part] = field(default_factory=list)
    texts: list = field(default_factory=list)

    def packed(self) -> list:
        return [self.name, self.often, [p.packed() for p in self.parts]]

    @classmethod
    def unpacked(cls, raw: list) -> Part:
        return cls(raw[0], raw[1], [cls.unpacked(p) for p in raw[2]])

    def shape(self) -> str:
        return self.name or "(" + " ".join(p.shape() for p in self.parts) + ")"

    def __str__(self) -> str:
        inside = "".join(map(str, self.parts))
        own = SLOT if self.name == SLOT else f"<{self.name}>{inside}</{self.name.split('.')[0].rstrip('*!')}>" if self.name else inside
        return f"({own}){self.often}" if self.often or not self.name else own


def optional(p: Part) -> Part:
    return Part(p.name, {"": "?", "+": "*"}.get(p.often, p.often), p.parts, p.texts)


def repeated(p: Part) -> Part:
    return Part(p.name, {"": "+", "?": "*"}.get(p.often, p.often), p.parts, p.texts)


def merged(a: Part, b: Part) -> Part:
    """The expression of two parts of one shape."""
    marks = a.often + b.often
    often = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[
        "?" in marks or "*" in marks, "+" in marks or "*" in marks
    ]
    return Part(a.name, often, aligned(a.parts, b.parts), a.texts + b.texts)


def aligned(xs: list[Part], ys: list[Part]) -> list[Part]:
    """Two sequences as one: matches are merged, and what is on one side only becomes optional."""
    if not xs or not ys:
        return folded([optional(p) for p in xs or ys])
    out: list[Part] = []
    for kind, a, b, c, d in SequenceMatcher(None, [x.shape() for x in xs], [y.shape() for y in ys], False).get_opcodes():
        if kind == "equal":
            out += [merged(x, y) for x, y in zip(xs[a:b], ys[c:d], strict=True)]
        else:
            out += [optional(p) for p in (*xs[a:b], *ys[c:d])]
    return folded(out)


def folded(parts: list[Part]) -> list[Part]:
    """Neighbours of one shape, or up to three that recur together, as a repeated part."""
    out: list[Part] = []
    for p in parts:
        out.append(p)
        for period in (1, 2, 3):
            # A group that is there already takes in another occurrence of its parts.
            if period > 1 and len(out) > period and not out[-period - 1].name and out[-period - 1].parts:
                group = out[-period - 1]
                if [x.shape() for x in group.parts] == [x.shape() for x in out[-period:]]:
                    out[-period - 1 :] = [repeated(Part("", group.often, aligned(group.parts, out[-period:])))]
                    break
            if len(out) < 2 * period or [x.shape() for x in out[-period:]] != [x.shape() for x in out[-2 * period : -period]]:
                continue
            if period == 1:
                out[-2:] = [repeated(merged(out[-2], out[-1]))]
            else:
                out[-2 * period :] = [Part("", "+", aligned(out[-2 * period : -period], out[-period:]))]
            break
    return out


@dataclass
class Block:
    path: str
    text: str
    linked: int


def own_names(value: str) -> Iterator[str]:
    """The name parts of a class or id that say what the element is."""
    for token in value.split():
        parts = [p.lower() for p in NAME_PART.findall(token)]
        if len(parts) < 2 or parts[0] not in FIRST_MODIFIERS and parts[-1] not in LAST_MODIFIERS:
            yield from parts


def element_name(tag: str, attributes: str, inside_article: bool, nested: bool = False) -> str:
    """The tag with its first class or id; * marks the article's element and ! what is not the article, !! if hidden.

    The page, its body and its main part are never marked by their names; an article only if `nested` in another one.
    """
    if not attributes.strip(" /"):
        mark = "!" if tag in BOILERPLATE or tag == "header" and not inside_article else "*" if tag in ARTICLE else ""
        return tag + mark
    found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    whole = tag in ("html", "body")
    names = [] if whole or tag in ARTICLE and not nested else [n for k in ("class", "id", "role", "itemprop") for n in own_names(found.get(k, ""))]
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    hidden = hidden and not whole
    bad = tag in BOILERPLATE or hidden or not BOILERPLATE_NAMES.isdisjoint(names)
    bad = bad or not inside_article and (tag == "header" or tag not in ARTICLE and "header" in names)
    good = tag in ARTICLE or found.get("role") == "main" or found.get("itemprop", "").lower() in MAIN_NAMES
    label = re.sub(r"\W+", "-", re.sub(r"\d+", "0", (found.get("class") or found.get("id") or "").split(" ")[0]))[:40]
    return tag + (f".{label}" if label else "") + ("!!" if hidden else "!" if bad else "*" if good else "")


def parsed(html: str | None) -> tuple[Part, list[Block]]:
    """A page's folded stream and its blocks of text in page order."""
    root = Part("")
    stack: list[tuple[str, Part]] = [("", root)]
    still_open: Counter = Counter()
    names: list[str] = []
    blocks: list[Block] = []
    buffer: list[str] = []
    linked, in_link, articles = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append(Block("/".join(names), text, min(linked, len(text))))
                stack[-1][1].parts.append(Part(SLOT, texts=[len(blocks) - 1]))
            linked = 0

    def close(depth: int) -> None:
        nonlocal articles
        flush()
        while len(stack) > depth:
            tag, part = stack.pop()
            still_open[tag] -= 1
            if part is not stack[-1][1]:
                part.parts = folded(part.parts)
                articles -= names.pop().endswith("*")

    html = html or ""
    at = 0
    while at < len(html):
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            buffer.append(text)
            linked += len(text) if in_link else 0
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            buffer.append(m[1].replace("&", "&amp;"))
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        ending, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag in RAW:
            if not ending and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            buffer.append(" ")
        elif tag not in BLOCKS:
            if tag == "a":
                in_link = max(0, in_link + (-1 if ending else 1))
            elif tag == "br":
                buffer.append(" ")
        elif ending:
            if still_open[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            else:
                flush()
        else:
            flush()
            while len(stack) > 1 and tag in ENDED_BY.get(stack[-1][0], ()):
                close(len(stack) - 1)
            if tag not in VOID:
                name = element_name(tag, attributes, articles > 0, still_open["article"] > 0)
                marks = name.endswith("*") and not articles or name.endswith("!") and not (names and names[-1].endswith("!"))
                part = stack[-1][1]
                if len(names) < DEEPEST or marks and len(names) < DEEPEST + 4:
                    part = Part(name)
                    stack[-1][1].parts.append(part)
                    names.append(name)
                    articles += name.endswith("*")
                stack.append((tag, part))
                still_open[tag] += 1
    close(1)
    root.parts = folded(root.parts)
    return root, blocks


def discarded(path: str) -> bool:
    """Hidden, or in an element that never holds an article."""
    return "!!" in path or "!" in path and any(x.endswith("!") and x[:-1].split(".")[0] in NEVER_ARTICLE for x in path.split("/"))


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def slots_of(tree: Part, path: tuple[str, ...] = ()) -> Iterator[tuple[str, Part]]:
    """A tree's slots with their paths, in order."""
    for p in tree.parts:
        if p.name == SLOT:
            yield "/".join(path), p
        else:
            yield from slots_of(p, (*path, p.name) if p.name else path)


def stream_of(tree: Part) -> tuple[str, str]:
    """A page's stream and the short name that it goes by."""
    stream = json.dumps(tree.packed(), separators=(",", ":"))
    return stream, hashlib.blake2b(stream.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


COUNTS = ["n", "chars", "linked", "low", "high", "differing"]


def streams(pages: DataFrame) -> DataFrame:
    """(host, kind, name, slot, stream, n, chars, linked, low, high, differing): a host's streams with their numbers of pages,
    and their slots by number with their texts' numbers, lengths, linked parts, smallest and greatest hashes, and the
    number of pages with other texts than each other, counted up to `COPIES` + 1 at least. Tasks sum what they have read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        pages_of: dict[tuple, set[int]] = {}

        def add(key: tuple, chars: int, linked: int, code: int, page: int) -> None:
            own = held.get(key)
            if own is None:
                held[key] = [1, chars, linked, code, code]
                pages_of[key] = {page}
            else:
                if len(pages_of[key]) <= COPIES:
                    pages_of[key].add(page)
                own[0] += 1
                own[1] += chars
                own[2] += linked
                own[3], own[4] = min(own[3], code), max(own[4], code)

        def out() -> pa.RecordBatch:
            host, kind, name, slot, stream = zip(*held, strict=True) if held else ([],) * 5
            counts = zip(*held.values(), strict=True) if held else ([],) * 5
            arrays = [*(pa.array(x, pa.string()) for x in (host, kind, name)), pa.array(slot, pa.int32()), pa.array(stream, pa.string())]
            arrays += [pa.array(x, pa.int64()) for x in counts]
            arrays.append(pa.array([sorted(x) for x in pages_of.values()], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=["host", "kind", "name", "slot", "stream", *COUNTS[:5], "pages"])

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tree, blocks = parsed(html.as_py())
                stream, name = stream_of(tree)
                add((host, "stream", name, -1, stream), 0, 0, 0, 0)
                own = [(k, path, [blocks[i] for i in slot.texts]) for k, (path, slot) in enumerate(slots_of(tree)) if not discarded(path)]
                codes = [zlib.crc32("\n".join(b.text for b in found).encode("utf-8", "surrogatepass")) for _, _, found in own]
                # What is marked as no article, such as an ad, may differ between copies.
                page = hash(tuple(c for (_, path, _), c in zip(own, codes, strict=True) if "!" not in path) or tuple(codes))
                for (k, _, found), code in zip(own, codes, strict=True):
                    add((host, "slot", name, k, None), sum(len(b.text) for b in found), sum(b.linked for b in found), code, page)
            if len(held) > 50_000:
                yield out()
                held.clear()
                pages_of.clear()
        yield out()

    schema = "host string, kind string, name string, slot int, stream string, n bigint, chars bigint, linked bigint, low bigint, high bigint, pages array<bigint>"
    sums = [F.sum(c).alias(c) for c in ("n", "chars", "linked")] + [F.min("low").alias("low"), F.max("high").alias("high")]
    sums.append(F.size(F.array_distinct(F.flatten(F.collect_set("pages")))).cast("bigint").alias("differing"))
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, schema)
    return rows.groupBy("host", "kind", "name", "slot", "stream").agg(*sums)


def marked_elements(path: str) -> Iterator[str]:
    """The paths of the elements marked as no article that `path` leads through."""
    names = path.split("/")
    for i, name in enumerate(names, 1):
        if name.endswith("!"):
            yield "/".join(names[:i])


def dropped(path: str, kept: set[str]) -> bool:
    return "!" in path and any(e not in kept for e in marked_elements(path))


def kept_elements(sizes: dict[str, int]) -> set[str]:
    """Marked elements that stay, by the lengths of varying text at each path: those with more than half of a host's. Where
    unmarked text makes up a fifth it is the article, and what is marked, such as many comments, is not."""
    total = sum(sizes.values())
    if 5 * sum(n for k, n in sizes.items() if not dropped(k, set())) >= total:
        return set()
    inside: dict[str, int] = {}
    for k, n in sizes.items():
        for e in marked_elements(k):
            inside[e] = inside.get(e, 0) + n
    return {e for e, n in inside.items() if 2 * n > total}


def article_slots(wrapper: Part, counts: dict) -> tuple[list, list]:
    """What stands behind the slots that hold the article where its element is marked, and where it is not: in the element
    with most of the text that neither is linked nor the same on all pages.

    `counts` has the COUNTS of what stands behind the wrapper's slots; they are put together by aligned position. A
    position with one text on all of more than COPIES different pages is the template's, inside a marked article as well.
    """
    positions = []
    for path, slot in slots_of(wrapper):
        known = [counts[x] for x in slot.texts if x in counts]
        if known:
            n, chars, linked, low, high, differing = zip(*known, strict=True)
            fixed = min(low) == max(high) and sum(differing) > COPIES
            positions.append((path, slot.texts, sum(chars), fixed, not fixed and 2 * sum(linked) <= sum(chars)))

    sizes: dict[str, int] = {}
    for path, _, chars, _, varying in positions:
        if varying:
            sizes[path] = sizes.get(path, 0) + chars
    kept = kept_elements(sizes)
    positions = [p for p in positions if not dropped(p[0], kept)]
    marked = [p for p in positions if any(x.endswith("*") for x in p[0].split("/"))]
    rest = [p for p in positions if p[4] and p not in marked]
    size: dict[tuple[str, ...], int] = {}
    for path, _, chars, _, _ in rest:
        size[tuple(path.split("/"))] = size.get(tuple(path.split("/")), 0) + chars
    inside: tuple[str, ...] = ()
    while size:
        below: dict[str, int] = {}
        for k, c in size.items():
            if len(k) > len(inside) + 1 and k[: len(inside)] == inside:
                below[k[len(inside)]] = below.get(k[len(inside)], 0) + c
        name = max(below, key=lambda x: (below[x], x), default=None)
        if name is None or below[name] < 0.6 * sum(size.values()):
            break
        inside = (*inside, name)
    article = [x for _, texts, _, fixed, _ in marked if not fixed for x in texts]
    plain = [x for path, texts, _, _, _ in rest if tuple(path.split("/"))[: len(inside)] == inside for x in texts]
    return article, plain


def aligned_streams(frame: pd.DataFrame, trees: list[Part]) -> Part:
    """One wrapper of trees in the frame's order: the most frequent first, so that the streams alone fix the order."""
    order = frame.sort_values(["n", "name"], ascending=[False, True]).index
    wrapper = trees[order[0]]
    for i in order[1:]:
        wrapper = Part("", "", aligned(wrapper.parts, trees[i].parts))
    return wrapper


#: A partial wrapper, its slots' counts, and which stream's slot became which of them; a whole wrapper, and the slots to read.
PARTIAL = "host string, kind string, name string, slot int, own int, stream string, place int, " + ", ".join(f"{c} bigint" for c in COUNTS)
WHOLE = "host string, kind string, own int, place int, pages bigint, wrapper string"


def _partial(frame: pd.DataFrame) -> pd.DataFrame:
    """The wrapper of one part of a host's streams. Its slots are numbered, and stand for the streams' slots from here on."""
    is_stream = frame["kind"] == "stream"
    rows = frame[is_stream].reset_index(drop=True)
    trees = []
    for name, stream in zip(rows["name"], rows["stream"], strict=True):
        tree = Part.unpacked(json.loads(stream))
        for k, (_, slot) in enumerate(slots_of(tree)):
            slot.texts = [(name, k)]
        trees.append(tree)
    wrapper = aligned_streams(rows, trees)
    counts = {(r.name_, r.slot): r for r in frame[~is_stream].rename(columns={"name": "name_"}).itertuples()}
    host, own = frame["host"].iloc[0], int(frame["own"].iloc[0])
    empty = [0] * len(COUNTS)
    out = [(host, "wrapper", f"{own:09d}", -1, own, json.dumps(wrapper.packed(), separators=(",", ":")), -1, int(rows["n"].sum()), *empty[1:])]
    for place, (_, slot) in enumerate(slots_of(wrapper)):
        known = [counts[x] for x in slot.texts if x in counts]
        if known:
            sums = [sum(getattr(r, c) for r in known) for c in ("n", "chars", "linked")]
            low, high = min(r.low for r in known), max(r.high for r in known)
            out.append((host, "slot", "", -1, own, None, place, *sums, low, high, sum(r.differing for r in known)))
        out += [(host, "map", name, k, own, None, place, *empty) for name, k in slot.texts]
    return pd.DataFrame(out, columns=["host", "kind", "name", "slot", "own", "stream", "place", *COUNTS])


def _whole(frame: pd.DataFrame) -> pd.DataFrame:
    """A host's wrapper, and the partial wrappers' slots that hold its article."""
    is_wrapper = frame["kind"] == "wrapper"
    rows = frame[is_wrapper].reset_index(drop=True)
    trees = []
    for own, stream in zip(rows["own"], rows["stream"], strict=True):
        tree = Part.unpacked(json.loads(stream))
        for place, (_, slot) in enumerate(slots_of(tree)):
            slot.texts = [(int(own), place)]
        trees.append(tree)
    wrapper = aligned_streams(rows, trees)
    counts = {(r.own, r.place): tuple(getattr(r, c) for c in COUNTS) for r in frame[~is_wrapper].itertuples()}
    article, plain = article_slots(wrapper, counts)
    host = frame["host"].iloc[0]
    out = [(host, "wrapper", -1, -1, int(rows["n"].sum()), str(wrapper))]
    out += [(host, kind, own, place, 0, None) for kind, found in (("article", article), ("plain", plain)) for own, place in found]
    return pd.DataFrame(out, columns=["host", "kind", "own", "place", "pages", "wrapper"])


def inferred(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each host's wrapper (host, pages, wrapper), and for its streams (host, name) the numbers of the slots that hold the
    article where its element is marked, and where it is not (article, plain).

    Pages without a host, null urls included, share one wrapper under the host "".
    """
    found = settled(streams(pages))  # pages are parsed once for it, though streams and slots are read apart
    parts = found.where(F.col("kind") == "stream").groupBy("host").agg(F.ceil(F.count(F.lit(1)) / STREAMS).alias("parts"))
    dealt = found.join(parts, "host").withColumn("own", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")).drop("parts")
    partial = settled(dealt.groupBy("host", "own").applyInPandas(_partial, PARTIAL))
    whole = settled(partial.where(F.col("kind") != "map").groupBy("host").applyInPandas(_whole, WHOLE))
    chosen = whole.where(F.col("kind") != "wrapper").select("host", "own", "place", F.col("kind").alias("part_of"))
    mapped = partial.where(F.col("kind") == "map").select("host", "own", "place", "name", "slot").join(chosen, ["host", "own", "place"])

    def numbers(kind: str):
        return F.array_sort(F.collect_list(F.when(F.col("part_of") == kind, F.col("slot")))).alias(kind)

    slots = mapped.groupBy("host", "name").agg(numbers("article"), numbers("plain"))
    return whole.where(F.col("kind") == "wrapper").select("host", "pages", "wrapper"), slots


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper): each host's expression."""
    return inferred(pages)[0]


def read_slots(blocks: list[Block], slots: list[Part], article: list[int], plain: list[int]) -> str:
    """The texts of the article's slots in page order; of the plain ones where the page has none of the others."""
    for numbers in (article, plain):
        held = [blocks[i].text for i in sorted(i for k in numbers for i in slots[k].texts)]
        if held:
            return "\n\n".join(held)
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """`pages` with `text` (the article's blocks, two line ends between them) and `n_chars`, from the whole html.

    Null and empty pages have an empty text. Columns of `pages` with these names are replaced. Pages keep their rows
    whatever else they hold; url is read for the host alone.
    """
    spark = pages.sparkSession
    pages = pages.drop("text", "n_chars")
    names = pages.columns
    known = settled(inferred(pages)[1])
    size = known.agg(F.sum(F.octet_length("host") + 8 * (F.size("article") + F.size("plain")) + 128)).first()[0]
    placed = pages.withColumn("__host", host_of(F.col("url")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    small = (size or 0) <= BROADCAST_BYTES
    table = spark.sparkContext.broadcast({(r.host, r.name): (r.article, r.plain) for r in known.collect()} if small else None)

    def name_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [stream_of(parsed(html.as_py())[0])[1] for html in batch.column("html")]
            yield batch.append_column("__name", pa.array(own, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            hosts = batch.column("__host").to_pylist()
            given = None if small else [batch.column(c).to_pylist() for c in ("__article", "__plain")]
            for i, html in enumerate(batch.column("html")):
                tree, blocks = parsed(html.as_py())
                slots = [slot for _, slot in slots_of(tree)]
                found = table.value.get((hosts[i], stream_of(tree)[1]), ((), ())) if small else (given[0][i] or (), given[1][i] or ())
                texts.append(read_slots(blocks, slots, *found))
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "text", "n_chars"])

    if not small:
        named = placed.mapInArrow(name_streams, f"{fields}, __host string, __name string")
        read = known.select(F.col("host").alias("__host"), F.col("name").alias("__name"), F.col("article").alias("__article"), F.col("plain").alias("__plain"))
        placed = named.join(read, ["__host", "__name"], "left").drop("__name")
    return placed.mapInArrow(run, f"{fields}, text string, n_chars bigint")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
