"""HTML extraction by composite text density.

One pass over a page's tags builds a small table of nodes. For every node it holds characters C,
tags T, characters and tags inside links (LC, LT). A node's density is its characters per tag,
lowered where links hold most of them:

    C / T * log base ln(C / (C - LC) * LC + LCb / Cb * C + e) of (C / LC * T / LT)

with b the body and zero counts taken as one. Each node's sum adds its children's densities. The
node with the largest sum holds the text; the smallest density on its path to the body is the
threshold under which a part of it is left out together with everything it holds, as long as the
part is mostly links. A node inside an ``article`` or ``main`` element stands for that whole
element. Elements that never hold article text (scripts, navigation, ...) end before the densities
are counted. Forms and elements with a class, id or role that names a menu, an advert, comments and
the like do too, unless they wrap the page: one that holds a ``main`` or the page's largest article
stays, and so does one with most of the body's characters outside links where no article stands
outside it. A section of comments stays only when next to nothing is left without it. Names count as
whole tokens ("sidebar", "cookie-notice", "site-header"; not "has-sidebar" or "entry-header").

Text: character references decoded, white space inside a block made one space and trimmed, blocks
in page order joined by two line breaks.

Defined results: null and empty pages give the empty text and 0 characters; a page without text
the same; unclosed, crossed and unknown tags are tolerated; null or repeated ids keep their rows.
Only the two named columns are read.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestrank.llm.common import slices, texts

_START, _NAME_END, _STOP = re.compile("/?[a-zA-Z]"), re.compile(r"[\s/>]"), re.compile("[>\"']")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "noscript", "template", "iframe", "svg")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_NEVER = frozenset(
    "head nav footer aside button select dialog menu object audio video canvas map datalist title".split()
)
_FORM = ("form", "fieldset")
_COMMENTS = frozenset("comment comments disqus replies reply respond".split())
_HEADS = frozenset("header masthead banner".split())
_NOISE = _COMMENTS | _HEADS | frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs consent cookie cookies footer menu modal "
    "nav navbar navigation newsletter notice notices popup promo promotion related share sharing sidebar signup skip social "
    "sponsor sponsored subscribe toolbar complementary contentinfo search alert".split()
)
# Words that may stand beside one of these in a token; beside a head only the first list.
_PLACES = frozenset("site global top bottom left right primary secondary".split())
_PARTS = _PLACES | frozenset(
    "area list wrap wrapper container box block section widget bar link links button buttons form inner body post posts "
    "article articles entry page".split()
)
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
_WHOLE = ("article", "main")
# Elements that an implied end tag does not reach across.
_WALLS = frozenset("table ul ol dl article section div body blockquote".split())
# Numeric references past the last code point, and leading zeros: cut before any number is read.
_ZEROS, _FAR = re.compile("&#0{2,}(?=[0-9])"), re.compile("&#[1-9][0-9]{8,};?")


class _Tags:
    """Ends of the tags of one page, in time linear in its length however many stay open.

    A walk from a tag's name skips quoted values. Quotes met on a walk that found no end are kept:
    a later walk that meets one of them ends there too, so no stretch is walked twice.
    """

    def __init__(self, source: str) -> None:
        self.source, self.last, self.dead = source, source.rfind(">"), set()
        self.seen = {_NAME_END: (0, -1), _STOP: (0, -1)}

    def first(self, pattern: re.Pattern, at: int) -> int:
        """First match at or after ``at``; the last answer serves all places before it."""
        low, stop = self.seen[pattern]
        if not low <= at <= stop:
            found = pattern.search(self.source, at)
            stop = found.start() if found else len(self.source)
            self.seen[pattern] = (at, stop)
        return stop

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends at ``at``; -1 if none does."""
        stop = self.first(_STOP, at)
        met = []
        while stop <= self.last:
            quote = self.source[stop]
            if quote == ">":
                return stop
            met.append(stop)
            closing = -1 if stop in self.dead else self.source.find(quote, stop + 1)
            found = _STOP.search(self.source, closing + 1) if closing >= 0 else None
            if not found:
                break
            stop = found.start()
        self.dead.update(met)
        return -1


def _kind(token: str, within: bool) -> int:
    """2 for a token that names comments, 1 for other noise, 0 else; an article's own header is no noise."""
    words = set(re.split("[-_]+", token.strip("-_")))
    named = words & _NOISE
    if not named or not words - named <= (_PLACES if named & _HEADS else _PARTS) or (within and named <= _HEADS):
        return 0
    return 2 if named & _COMMENTS else 1


def _noisy(name: str, attributes: str, within: bool) -> int:
    """0 for text, 1 for noise by name, 2 for comments, 3 for elements that never hold text."""
    if name in _NEVER or (name == "header" and not within):
        return 3
    kind = int(name in _FORM)
    if not attributes or name in ("html", "body", "main"):
        return kind
    for m in _NAMED.finditer(attributes):
        for token in next(filter(None, m.groups()), "").lower().split():
            kind = max(kind, _kind(token, within))
    return kind if name != "article" or kind == 2 else 0


class _Page:
    """Nodes of one page and its text runs, each with its node and block."""

    def __init__(self, source: str) -> None:
        self.names, self.parents = ["#page"], [0]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.runs: list[tuple[int, int, str]] = []
        self.stack, self.block, self.muted, self.links = [0], 0, 0, 0
        self.places: dict[str, list[int]] = {}  # depths at which a name is open
        self.walls = [0]
        self.named: dict[int, int] = {}
        self._read(source)
        if self.named:
            self._mute()

    def _read(self, source: str) -> None:
        tags, start, at, size = _Tags(source), 0, 0, len(source)
        while (at := source.find("<", at)) >= 0:
            name_end, end = 0, -1
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4) + 2
                end = end if end > 1 else size - 1
            elif source.startswith(("<!", "<?"), at):
                end = source.find(">", at) if at < tags.last else -1
            elif begins := _START.match(source, at + 1):
                name_end = tags.first(_NAME_END, begins.end())
                end = tags.end(name_end)
            if end < 0:  # no tag: the sign is text
                at += 1
                continue
            if at > start and not self.muted:
                self._text(source[start:at])
            at = end + 1
            if name_end:
                word = source[begins.end() - 1 : name_end].lower()
                if source[begins.start()] == "/":
                    self._close(word)
                elif word in _RAW:
                    closing = _RAW[word].search(source, at)
                    at = closing.end() if closing else size
                    self.block += 1
                else:
                    self._open(word, source[name_end:end])
            start = at
        if start < size and not self.muted:
            self._text(source[start:])

    def _text(self, raw: str) -> None:
        if "&" in raw:
            raw = html.unescape(_FAR.sub("\N{REPLACEMENT CHARACTER}", _ZEROS.sub("&#", raw)))
        if raw.isspace():
            if self.runs and self.runs[-1][1] == self.block:
                self.runs.append((self.stack[-1], self.block, " "))
            return
        node = self.stack[-1]
        count = len("".join(raw.split()))
        self.chars[node] += count
        if self.links:
            self.link_chars[node] += count
        self.runs.append((node, self.block, raw))

    def _open(self, name: str, attributes: str) -> None:
        if name == "br":
            if not self.muted:
                self.runs.append((self.stack[-1], self.block, " "))
                self.tags[self.stack[-1]] += 1
            return
        inline = name in _INLINE
        if not inline:
            self.block += 1
            for other in (*_CLOSES.get(name, ()), "p"):
                self._close(other, self.walls[-1])
        if name in _VOID:
            if not self.muted:
                self.tags[self.stack[-1]] += 1
            return
        node, within = len(self.names), any(self.places.get(n) for n in _WHOLE)
        self.names.append(name)
        self.parents.append(self.stack[-1])
        self.chars.append(0)
        self.tags.append(1)
        self.link_chars.append(0)
        self.link_tags.append(0)
        self.places.setdefault(name, []).append(len(self.stack))
        if name in _WALLS:
            self.walls.append(len(self.stack))
        self.stack.append(node)
        if name == "a":
            self.links += 1
            self.link_tags[node] = 1
        if self.muted:
            self.muted += 1
            return
        kind = _noisy(name, attributes, within)
        if kind == 3:
            self.muted += 1
        elif kind:
            self.named[node] = kind

    def _close(self, name: str, wall: int = 0) -> None:
        """End the innermost open element of this name, if it stands inside the wall, and all in it."""
        places = self.places.get(name)
        if not places or places[-1] < wall:
            return
        depth = places[-1]
        if name not in _INLINE:
            self.block += 1
        for node in self.stack[depth:]:
            self.places[self.names[node]].pop()
            self.links -= self.names[node] == "a"
        while self.walls[-1] >= depth > 0:
            self.walls.pop()
        self.muted = max(0, self.muted - (len(self.stack) - depth))
        del self.stack[depth:]

    def _mute(self) -> None:
        """Take the text out of the noise elements, but for those that wrap what the page is about."""
        count = len(self.names)
        words, ends = [c - lc for c, lc in zip(self.chars, self.link_chars)], list(range(1, count + 1))
        for node in range(count - 1, 0, -1):  # a node's descendants are the numbers up to its end
            up = self.parents[node]
            words[up] += words[node]
            ends[up] = max(ends[up], ends[node])
        whole = [n for n in range(count) if self.names[n] in _WHOLE and n not in self.named and words[n]]
        largest = max(whole, key=lambda n: words[n], default=0)
        mains = [n for n in whole if self.names[n] == "main"]
        above, held = [0] * count, set(whole)
        for node in range(1, count):
            above[node] = above[self.parents[node]] + (self.parents[node] in held)
        out, left, node = [], words[0], 1
        while node < count:
            kind, end = self.named.get(node, 0), ends[node]
            wraps = node < largest < end or bisect(mains, node) < bisect(mains, end - 1)
            if kind == 1 and not wraps or kind == 2 and wraps:
                # without an article or main outside it, what holds most of the text is the page
                inside = bisect(whole, end - 1) - bisect(whole, node)
                wraps = 2 * words[node] > words[0] and inside + above[node] == len(whole)
            if kind and not wraps:
                out.append((node, end))
                left -= words[node]
                node = end
            else:
                node += 1
        if 10 * left < words[0]:
            return
        gone = bytearray(count)
        for node, end in out:
            for n in range(node, end):
                gone[n], self.chars[n], self.link_chars[n], self.tags[n] = 1, 0, 0, 1
        self.runs = [run for run in self.runs if not gone[run[0]]]

    def densities(self) -> tuple[list[float], list[float]]:
        """Density of every node and the sum of its children's densities."""
        count = len(self.names)
        for node in range(count - 1, 0, -1):  # children come after their parents
            up = self.parents[node]
            self.chars[up] += self.chars[node]
            self.tags[up] += self.tags[node]
            self.link_chars[up] += self.link_chars[node]
            self.link_tags[up] += self.link_tags[node]
        body = self.names.index("body") if "body" in self.names else 0
        body_share = self.link_chars[body] / max(self.chars[body], 1)
        density, sums = [0.0] * count, [0.0] * count
        for node in range(count - 1, -1, -1):
            c, t, lc, lt = self.chars[node], max(self.tags[node], 1), self.link_chars[node], self.link_tags[node]
            if c:
                base = math.log(c / max(c - lc, 1) * lc + body_share * c + math.e)
                ratio = c / max(lc, 1) * t / max(lt, 1)
                density[node] = c / t * (math.log(ratio) / math.log(base) if base > 1.0001 else math.log(ratio) + 1)
                density[node] = max(density[node], 0.0)
            if node:
                sums[self.parents[node]] += density[node]
        return density, sums

    def path(self, node: int) -> list[int]:
        """The node and its ancestors, up to the body."""
        out = [node]
        while node and self.names[node] != "body":
            node = self.parents[node]
            out.append(node)
        return out

    def text(self) -> str:
        density, sums = self.densities()
        if not self.chars[0]:
            return ""
        top = max(range(len(sums)), key=lambda n: (sums[n], self.chars[n], -n))
        if sums[top] == 0:
            top = 0
        path = self.path(top)
        threshold = min(density[n] for n in path)
        top = next((n for n in reversed(path) if self.names[n] in _WHOLE), top)
        kept = [False] * len(self.names)
        kept[top] = True
        for node in range(top + 1, len(self.names)):
            mostly_links = 2 * self.link_chars[node] > self.chars[node] and self.names[node] not in _INLINE
            kept[node] = kept[self.parents[node]] and not (mostly_links and density[node] < threshold)
        blocks: dict[int, list[str]] = {}
        for node, block, raw in self.runs:
            if kept[node]:
                blocks.setdefault(block, []).append(raw)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n\n".join(line for line in lines if line)


def main_text(source: str) -> str:
    """Article text of one page."""
    return _Page(source).text() if source else ""


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of every row, then text and n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html"):
                found = [main_text(page) for page in texts(part, "_html")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                    [*keep, "text", "n_chars"],
                )

    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return pages.select(*keep, F.col(html_col).cast("string").alias("_html")).mapInArrow(
        run, f"{kinds}text string, n_chars long"
    )
