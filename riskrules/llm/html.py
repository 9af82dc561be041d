"""Main text of web pages by consensus paths of their host.

1. Each page is parsed leniently once; every container (body, main, article,
   section, div, td) gets a score from the text it holds, discounted by links,
   and names its generalised path: tags with classes, numbers taken out.
2. Pages of a host vote: Spark sums the scores of each page's best path per
   (host, path); paths with a tenth of a host's votes win.
3. Pages are extracted again with their host's winners: a page keeps its own best
   path if it won, else takes the strongest winning path it contains, else its
   own best.  So pages whose own scores mislead (short articles beside long
   notices) follow their host.

The text of a path is every block of its containers outside menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments;
nothing is dropped for length.  A class or id names such a part by a whole token or
its last word ("cookie-notice"; not "has-sidebar", "related-work"), whatever its
length, and never removes an element that holds the page's first article or main.
Character references are decoded, white space in a block becomes one space, blocks
are joined by two line feeds.

Defined results: null or empty html gives empty text (so does a page that holds
notices only); long pages are read whole, in time and memory by their length; of
equal scores the path that sorts last is a page's best, of equal votes the greater
score and then the path that sorts first wins; a null url is a host of its
own (empty); pages without any container use the whole page; rows that repeat a
page_id are extracted one by one; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_table

#: Least share of a host's votes of a winning path.
WINS = 0.1

# HTML elements by the part they play.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = set(
    "head nav header footer aside form dialog menu button select textarea label option noscript template iframe svg "
    "object canvas audio video script style title".split()
)
CONTAINERS = set("body main article section div td".split())
BAD_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
BAD_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side nav navbar "
    "navigation menu breadcrumb breadcrumbs header masthead footer comment comments disqus respond reply cookie cookies "
    "consent gdpr notice notices newsletter subscribe subscription signup share sharing social related recommended "
    "recommendations popup modal overlay widget toolbar pagination pager login search form hidden disclaimer copyright".split()
)
#: First words of tokens that say something about an element, not what it is.
ABOUT = set("has with no without overflow".split())
GOOD_NAMES = set("article post entry content story body text main".split())
#: Elements whose start ends an open element of the same list, up to the border.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
        "option": ({"option"}, {"select"})}
#: An open paragraph ends at the next block, but not across these.
P_BORDER = set("article aside body button div fieldset figure footer form header li main nav section table td th".split())

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<svg(?=[\s/])(?>[^>"']++|"[^"]*+"|'[^']*+')*+(?<=/)>
    |<(script|style|textarea|title|noscript|template|svg|iframe)(?=[\s/>])(?>[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)
    |<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>
    |<[!?/][^>]*(?:>|\Z)
    |<[a-zA-Z][^<>]*\Z""",
    re.S | re.I | re.X,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")


class _Open:
    """An open element; ``box`` is the nearest container (itself if it is one),
    ``part`` the nearest element with a bad name."""

    __slots__ = ("tag", "path", "out", "box", "link", "part")

    def __init__(self, tag, path, out, box, link, part):
        self.tag, self.path, self.out, self.box, self.link, self.part = tag, path, out, box, link, part


class _Part:
    """An element with a bad name, judged when the page is read."""

    __slots__ = ("up", "holds", "out")

    def __init__(self, up):
        # holds: the page's first article or main lies in it
        self.up, self.holds, self.out = up, False, False


class _Box:
    """A container: path, parent container, and the score of its own blocks."""

    __slots__ = ("path", "tag", "up", "own", "named", "part")

    def __init__(self, path, tag, up, named, part):
        self.path, self.tag, self.up, self.own, self.named, self.part = path, tag, up, 0.0, named, part


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _names(attrs: dict[str, str]) -> set[str]:
    return {p.lower() for p in NAME_PARTS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")}


def _heads(attrs: dict[str, str]) -> set[str]:
    """What the tokens of class and id call an element: their last words."""
    words = [[p.lower() for p in NAME_PARTS.findall(t)] for t in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()]
    return {w[-1] for w in words if w and w[0] not in ABOUT} | {w[0] for w in words if len(w) == 1}


def _is_out(tag: str, attrs: dict[str, str], stack: list[_Open]) -> bool:
    if tag in LEFT_OUT:
        return True
    if tag == "article" and any(o.tag == "article" for o in stack):
        return True  # an article inside an article is a reader's comment
    if not attrs or tag in ("html", "body", "main", "article"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in BAD_ROLES:
        return True
    return "display:none" in attrs.get("style", "").replace(" ", "")


def _step(tag: str, attrs: dict[str, str]) -> str:
    """Generalised step of a path: the tag and its classes without numbers."""
    classes = sorted({re.sub(r"\d+", "", c) for c in attrs.get("class", "").lower().split()} - {""})
    return ".".join([tag, *classes])


class Page:
    """Blocks and containers of one page."""

    def __init__(self, text: str):
        root = _Box("", "", None, False, None)
        self.boxes = [root]
        self.blocks: list[tuple[_Box, str]] = []
        self.stack = [_Open("", "", False, root, False, None)]
        self.pieces: list[tuple[str, bool, _Part | None]] = []
        self.read: list[tuple[_Box, list[tuple[str, bool, _Part | None]]]] = []
        self.parts: list[_Part] = []
        self.first: _Open | None = None
        at = 0
        for m in MARKUP.finditer(text):
            if m.start() > at:
                self._text(text[at : m.start()])
            at = m.end()
            if m[3]:
                self._tag(m[2], m[3].lower(), m[4])
            elif m[6]:
                self._tag(m[5], m[6].lower(), m[7])
        self._text(text[at:])
        self._flush()
        self._judge()

    def _text(self, s: str) -> None:
        top = self.stack[-1]
        if s and not top.out:
            self.pieces.append((s, top.link, top.part))

    def _flush(self) -> None:
        if self.pieces:
            self.read.append((self.stack[-1].box, self.pieces))
            self.pieces = []

    def _judge(self) -> None:
        """Leave out the parts with bad names, and score the blocks that stay."""
        for p in self.parts:  # outer ones first
            p.out = not p.holds or (p.up is not None and p.up.out)
        for box, pieces in self.read:
            kept = [(s, link) for s, link, p in pieces if p is None or not p.out]
            block = SPACE.sub(" ", references.unescape("".join(s for s, _ in kept))).strip()
            if block:
                self.blocks.append((box, block))
                box.own += max(0, len(block) - 2 * sum(len(s) for s, link in kept if link))
        self.boxes = [b for b in self.boxes if b.part is None or not b.part.out]
        self.read = []

    def _close(self, k: int) -> None:
        """Pop down to depth k."""
        if any(o.tag in BLOCKS for o in self.stack[k:]):
            self._flush()
        del self.stack[k:]

    def _tag(self, end: str, tag: str, rest: str) -> None:
        stack = self.stack
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    return self._close(k)
            if tag in BLOCKS:
                self._flush()
            return None
        if tag in VOID:
            if tag == "br" and not stack[-1].out:
                self.pieces.append((" ", False, stack[-1].part))
            elif tag == "hr":
                self._flush()
            return None
        if tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    self._close(k)
                    break
                if stack[k].tag in P_BORDER:
                    break
            self._flush()
        if tag in ENDS:
            ended, border = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in border:
                    break
                if stack[k].tag in ended:
                    self._close(k)
                    break
        top = stack[-1]
        attrs = _attributes(rest)
        names = _names(attrs) if "class" in attrs or "id" in attrs else set()
        out = top.out or _is_out(tag, attrs, stack)
        path, box, part = top.path, top.box, top.part
        if names & BAD_NAMES and not out and tag not in ("html", "body", "main", "article") and _heads(attrs) & BAD_NAMES:
            part = _Part(part)
            self.parts.append(part)
        if tag in BLOCKS:
            path = f"{path}>{_step(tag, attrs)}" if path else _step(tag, attrs)
            if tag in CONTAINERS and not out:
                named = bool(names & GOOD_NAMES) or attrs.get("role") == "main" or "articleBody" in attrs.get("itemprop", "")
                box = _Box(path, tag, top.box, named, part)
                self.boxes.append(box)
        stack.append(_Open(tag, path, out, box, top.link or tag == "a", part))
        if self.first is None and not out and (tag in ("article", "main") or attrs.get("role") == "main" or "articleBody" in attrs.get("itemprop", "")):
            self.first = stack[-1]
            while part is not None:
                part.holds, part = True, part.up
        return None

    def best(self) -> tuple[str, int]:
        """Path of the best container and its score (0: no text)."""
        score: dict[str, float] = defaultdict(float)
        for box in self.boxes:
            share, b = box.own, box
            while b is not None and share >= 1:
                bonus = 3.0 if b.tag in ("article", "main") else 1.5 if b.named else 1.0
                score[b.path] += share * bonus
                share, b = share / 2, b.up
        if not score:
            return "", 0
        path = max(score, key=lambda p: (score[p], p))
        box = next(b for b in self.boxes if b.path == path)
        up = box
        while up is not None:  # all of the article that holds it
            if up.tag == "article":
                box = up
                break
            up = up.up
        return box.path, int(score[path])

    def text(self, path: str) -> str:
        """Blocks inside the containers of a path, in page order."""
        inside: dict[int, bool] = {}

        def holds(b) -> bool:
            if b is None:
                return False
            k = id(b)
            if k not in inside:
                inside[k] = b.path == path or holds(b.up)
            return inside[k]

        return "\n\n".join(t for b, t in self.blocks if holds(b))


def main_text(page: Page, winners: list[str] | None = None) -> str:
    """Text by the host's winning paths, strongest first."""
    own = page.best()[0]
    if winners and own not in winners:
        for path in winners:
            if text := page.text(path):
                return text
    return page.text(own)


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without user and port; '' if none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [Page(h or "").best() for h in b.column("html").to_pylist()]
        yield pa.record_batch([b.column("host"), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.int64())], names=["host", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(Page(h or ""), w) for h, w in zip(b.column("html").to_pylist(), b.column("winners").to_pylist(), strict=True)]
        yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, winners``: the winning paths of each host, most votes first."""
    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_vote, "host string, path string, score long")
    sums = votes.where("score > 0").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    sums = shared_table(sums, "votes")
    total = sums.groupBy("host").agg(F.sum("votes").alias("all"))
    kept = sums.join(total, "host").where(F.col("votes") >= F.lit(WINS) * F.col("all"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")))
    return kept.groupBy("host").agg(F.transform(order, lambda x: x["path"]).alias("winners"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text``: the main text of every page."""
    winners = shared_table(host_paths(pages), "paths")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # a plain join: Spark broadcasts the paths while they are small, and splits hot hosts otherwise
    joined = rows.withColumn("host", host_of(F.col("url"))).join(winners, "host", "left")
    return joined.select("page_id", "url", "html", "winners").mapInArrow(_extract, "page_id long, url string, text string")
