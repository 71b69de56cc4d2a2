"""Main-content extraction by maximum-scoring subsequence (Pasternack and Roth, 2009).

A page is a sequence of words and tags, each with a score; one linear scan finds the contiguous region with the
highest total, which is the content. Tags score negative; words score positive where they stand as content words
do and negative where they stand as the words of menus, adverts and footers do. All scores are learned on labelled
pages, those that mark their content with exactly one <article> or <main> element: at most `sample` of them
(those with the smallest hash of their id), none longer than `longest` characters.

 - A tag scores its log-odds of standing inside rather than outside the content, from `tag_least` to `tag_most`;
   its feature is its name, and with its class, id and role where the labelled pages have that. The tags between two
   neighbours of one kind (paragraphs, items, rows, whatever their element is) cost nothing.
 - A word scores 2p - 1, p being the naive Bayes probability of content given the innermost block element, whether
   it is in a link, whether it stands in the page's only article or main (else the page's only one is elsewhere, or
   there is none), the number of words of its block and its neighbours of the same kind, and how many of those are in
   links. So a page whose elements have no telling names is decided by the scan alone.
 - Names of tags are not learned from elements that are left out anyway (below), and the block element of words in such
   counts for little (LEFT_LEAST): that adverts are div does not make text in div one.
 - Within the page's only article or main a word scores at least LEAST_INSIDE and a tag nothing, so lists, tables and
   short blocks at its ends are in the region.

The region is widened to whole blocks and to headings right before it. Of what is in it, elements that are never article text are left out (and score nothing
in the scan, so that they end no region): scripts, styles, forms, menus, headers and footers outside the content
element, sidebars, and elements whose class, id or role says advert, notice, comments and so on (NEVER,
NEVER_MARKS). What wraps the content is no such element: one that holds the article, main or h1, and, for forms, asides and
those with a telling part of a longer name only, one that holds most of the page's words outside links. Character references are decoded, white space inside a block becomes one space, blocks are
joined by an empty line. A page is read in time proportional to its length, however malformed.

Defined cases: a null or empty html gives an empty text, as does a page without words; without labelled pages
the default scores hold; of regions with equal totals the first, and of those the shortest, counts; a "<" that
begins no tag is text, as is a tag that never ends; pages of any length are read whole; rows that repeat an id are
pages of their own; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, LONGEST, TAG_MOST, TAG_LEAST, FEATURE_MOST, MILD, UNSEEN = 600, 200_000, -0.05, -6.0, 4.0, -0.1, -2.0
LEAST_INSIDE, LEFT_LEAST = 0.1, -2.0

NEVER = frozenset(
    "head title nav aside form script style noscript template button select textarea iframe object svg canvas dialog menu input label".split()
)
NEVER_MARKS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent notice notices alert "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus respond replies "
    "share sharing social related recommended newsletter subscribe signup popup modal overlay paywall pagination widget toolbar".split()
)
#: Parts of a name after which the rest says what an element has or has not beside it; parts that say so only at a name's ends.
_BESIDE, _VAGUE = frozenset("has with no without".split()), frozenset("widget alert notice banner social toolbar".split())
#: Elements that are left out unless they hold most of the page's words.
_MAY_WRAP = frozenset("form aside".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Tags that stand in running text; where the labelled pages do not have them they cost little.
TEXT_TAGS = frozenset(
    "p h1 h2 h3 h4 h5 h6 a abbr b bdi bdo blockquote br center cite code dd del dfn dl dt em figcaption figure font hr i img ins kbd li mark ol "
    "pre q s samp section small span strike strong sub summary sup table tbody td tfoot th thead time tr tt u ul var wbr !*".split()
)  # "!*" is a comment
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg title".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag, ">" in quotes not being its end. Nothing here is matched in two ways, so a failure is found in one go.
_TAG_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
#: One attribute, name and value; matched one after the other, so that no name is found inside a value.
_ATTRIBUTE = re.compile(r"([^\s/>=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_COMMENT_END = re.compile(r"--!?>")
_PARTS = re.compile(r"[a-z0-9]+")


@dataclass(slots=True)
class Event:
    """A run of text (name is empty) or a tag."""

    name: str
    text: str = ""
    end: bool = False
    marks: tuple[str, ...] = ()
    never: int = 0  # of NEVER_MARKS: 2 if a whole name is one, 1 if a part of a name is
    hidden: bool = False
    words: int = 0

    @property
    def feature(self) -> str:
        return ("/" if self.end else "") + self.name


def _says_never(name: str) -> int:
    if name in NEVER_MARKS:
        return 2
    parts = _PARTS.findall(name)
    told = [i for i, part in enumerate(parts) if part in NEVER_MARKS and (part not in _VAGUE or i in (0, len(parts) - 1))]
    return int(any(_BESIDE.isdisjoint(parts[:i]) for i in told))


def _marks(attrs: str) -> tuple[tuple[str, ...], int, bool]:
    """Parts of class, id and role; whether these say never; whether the element is hidden."""
    marks, never, hidden = [], 0, False
    for name, a, b, c in _ATTRIBUTE.findall(attrs):
        value, name = (a or b or c).lower(), name.lower()
        if name in ("class", "id", "role"):
            marks += _PARTS.findall(value)
            never = max([never, *map(_says_never, value.split())])
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    return tuple(marks), never, hidden


def events(page: str) -> list[Event]:
    """Text and tags. What a raw element holds is skipped up to its end tag; one that has none is a tag like others,
    but a script then goes on to the end of the page. No part of the page is searched twice in vain."""
    out: list[Event] = []
    text: list[str] = []  # the parts of the run of text that is being read
    at, n, last, quotes, endless = 0, len(page), page.rfind(">"), True, set()

    def flush() -> None:
        if text:
            run = "".join(text)
            run = html.unescape(run) if "&" in run else run
            out.append(Event("", run, words=len(run.split())))
            text.clear()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text.append(page[at:lt])
        if lt == n:
            break
        at = lt
        if page.startswith("<!--", at):
            short = 5 if page.startswith(">", at + 4) else 6 if page.startswith("->", at + 4) else 0  # a comment of nothing
            end = None if short else _COMMENT_END.search(page, at + 4)
            flush()
            out.append(Event("!*"))
            at = at + short if short else end.end() if end else n
            continue
        if at > last:  # no tag ends any more
            text.append(page[at:])
            break
        if page.startswith(("<!", "<?"), at):
            flush()
            out.append(Event("!*"))
            at = page.index(">", at) + 1
            continue
        closing = page.startswith("/", at + 1)
        found = _NAME.match(page, at + 1 + closing)
        if not found:
            text.append("<")
            at += 1
            continue
        rest = _TAG_REST.match(page, found.end()) if quotes else None
        if not rest:
            quotes = False  # from here on quotes do not pair
        end = rest.end() if rest else page.index(">", found.end()) + 1
        name, attrs = found[0].lower(), page[found.end() : end - 1]
        flush()
        at = end
        if name in _RAW and not closing:
            over = end if name == "svg" and attrs.endswith("/") else 0
            if not over and name not in endless:
                to = _RAW_END[name].search(page, at)
                over = page.find(">", to.end()) + 1 if to else 0
                if not over:
                    endless.add(name)
            if over or name == "script":
                at = over or n
                out.append(Event(f"{name}*"))
                continue
        marks, never, hidden = _marks(attrs) if attrs and not closing else ((), 0, False)
        out.append(Event(name, end=closing, marks=marks, never=never, hidden=hidden))
    flush()
    return out


_SAME = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th")}
_SIZES = (2, 5, 10, 20, 40)
_CELLS = frozenset("td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def element(page: list[Event]) -> tuple[int, int] | None:
    """The events inside the page's only article or else main that is in no other such element."""
    for name in ("article", "main"):
        depth, begun, found = 0, 0, []
        for i, e in enumerate(page):
            if e.name == name:
                if not e.end:
                    begun = begun if depth else i
                    depth += 1
                elif depth:
                    depth -= 1
                    if not depth:
                        found.append((begun + 1, i))
        found = [x for x in found if page[x[0] - 1].never < 2] or found  # not a comment's own article
        if not depth and len(found) == 1:
            return found[0]
    return None


def places(page: list[Event], inside: tuple[int, int] | None) -> tuple[list[tuple[str, ...]], set[int]]:
    """For each run of text the features of where it stands: its innermost block element, whether it is in a link and in the
    content element, and the size of its block with its neighbours of the same kind and the share of it that is links. Tags
    have none. And the tags between such neighbours: the end of an element with text, and the beginning of one of its
    name right after it or in the middle of its text."""
    open_: list[str] = []
    count: Counter[str] = Counter()
    block, link = 0, False
    runs: list[tuple[int, int, str, bool]] = []
    words: list[int] = [0]
    linked: list[int] = [0]
    group: list[int] = [0]  # the first block of the neighbours
    between: set[int] = set()
    left = -1  # the end tag of a block with text, of block `ended`, after which no other tag and no word has come
    ended = 0
    for i, e in enumerate(page):
        name = e.name
        if name or e.words:
            follows = left if name and not e.end and left >= 0 and page[left].name == name else -1
            left = -1
        if not name:
            words[block] += e.words
            linked[block] += e.words * link
            runs.append((i, block, open_[-1] if open_ else "", link))
        elif name == "a":
            link = not e.end
        elif name in BLOCKS or name in _CELLS:
            if e.end and open_ and open_[-1] == name and words[block]:
                left, ended = i, block
            goes_on = not e.end and bool(open_) and open_[-1] == name and words[block] > 0  # one in the text of another
            block += 1
            words.append(0), linked.append(0), group.append(block)
            if follows >= 0:
                group[block] = group[ended]
                between |= {follows, i}
            elif goes_on:
                group[block] = group[block - 1]
                between.add(i)
            link = False
            if not e.end:
                while open_ and open_[-1] in _SAME.get(name, ("p",)):
                    count[open_.pop()] -= 1
                if name not in _VOID:
                    open_.append(name)
                    count[name] += 1
            elif count[name]:
                while (gone := open_.pop()) != name:
                    count[gone] -= 1
                count[name] -= 1
    for b, g in enumerate(group):
        if g != b:
            words[g] += words[b]
            linked[g] += linked[b]
    out: list[tuple[str, ...]] = [()] * len(page)
    for i, b, parent, in_link in runs:
        n, k = words[group[b]], linked[group[b]]
        here = () if not inside else (f"element {int(inside[0] <= i < inside[1])}",)
        out[i] = (f"in {parent}", f"link {int(in_link)}", f"size {bisect_right(_SIZES, n)}", f"links {0 if not k else 1 + (2 * k > n)}", *here)
    return out, between


@dataclass
class Weights:
    words: dict[str, float] = field(default_factory=dict)  # log-odds of the features of places()
    tags: dict[str, float] = field(default_factory=dict)

    def of(self, e: Event, place: tuple[str, ...]) -> float:
        if not e.name:
            if not self.words:
                return e.words * (-0.5 if place[1] == "link 1" else 1.0)
            return e.words * math.tanh(sum(self.words.get(f, 0.0) for f in place) / 2)
        for mark in e.marks:
            if (w := self.tags.get(f"{e.feature}.{mark}")) is not None:
                return w
        return self.tags.get(e.feature, MILD if e.name in TEXT_TAGS else UNSEEN)


def fit(pages: list[str]) -> Weights:
    """Log-odds of tags and of the places of words on the labelled pages among these."""
    tags, words = (Counter(), Counter()), (Counter(), Counter())
    total = [0, 0]
    apart: set[str] = set()  # block elements seen elsewhere than in what is left out
    for page in map(events, pages):
        inside = element(page)
        if not inside:
            continue
        where, between = places(page, inside)
        unseen = {k for i, j in _left_out(page, ("head",)) for k in range(i, j)}
        furniture = {k for i, j in _left_out(page) for k in range(i, j)}
        for i, (e, place) in enumerate(zip(page, where)):
            if i in unseen:
                continue
            to = int(inside[0] <= i < inside[1] and i not in furniture)
            if not e.name:
                total[to] += e.words
                for f in place:
                    words[to][f] += e.words
                if i not in furniture:
                    apart.add(place[0])
            elif i not in furniture and i not in between and e.name != "!*":
                tags[to][e.feature] += 1
                for mark in e.marks:
                    tags[to][f"{e.feature}.{mark}"] += 1
    if not total[1]:
        return Weights()

    def odds(counts: tuple[Counter, Counter], f: str, whole: list[int]) -> float:
        return math.log((counts[1][f] + 0.5) / (whole[1] + 1)) - math.log((counts[0][f] + 0.5) / (whole[0] + 1))

    every = [sum(n for f, n in c.items() if "." not in f) + total[k] for k, c in enumerate(tags)]
    held = lambda x, least, most: max(least, min(most, x))
    return Weights(
        {f: held(odds(words, f, total), LEFT_LEAST if f.startswith("in ") and f not in apart else -FEATURE_MOST, FEATURE_MOST) for f in words[0] | words[1]},
        {f: held(odds(tags, f, every), TAG_LEAST, TAG_MOST) for f in tags[0] | tags[1]},
    )


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest sum (empty if none is above 0)."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def region(page: list[Event], scores: list[float], gone: list[tuple[int, int]] = []) -> tuple[int, int]:  # noqa: B006 (is only read)
    """The best region, widened to the blocks that it begins and ends in and to headings before it."""
    start, end = best_region(scores)
    if start < end:
        while start and page[start - 1].name not in BLOCKS:
            start -= 1
        before, dropped = start, [i for i, _ in gone]
        while before:
            before -= 1
            k = bisect_right(dropped, before) - 1
            if k >= 0 and before < gone[k][1]:
                before = gone[k][0]
            elif not page[before].name and page[before].words:
                break
            elif page[before].name in _HEADINGS and not page[before].end:
                start = before
            elif page[before].name in _HEADINGS:
                while before and page[before - 1].name not in BLOCKS:
                    before -= 1
        while end < len(page) and page[end].name not in BLOCKS:
            end += 1
    return start, end


def _left_out(page: list[Event], only: tuple[str, ...] = ()) -> list[tuple[int, int]]:
    """Elements that are never article text, or those named `only`: ranges of events."""
    close: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for i, e in enumerate(page):
        if e.name and not e.end and e.name not in _VOID:
            open_.setdefault(e.name, []).append(i)
        elif e.end and open_.get(e.name):
            close[open_[e.name].pop()] = i
    before = [0]  # words outside links up to an event
    link = False
    for e in page:
        link = not e.end if e.name == "a" else link and e.name not in BLOCKS
        before.append(before[-1] + e.words * (not link))
    inside = [(i, j) for i, j in close.items() if page[i].name in ("article", "main")]
    contents = sorted(i for i, _ in inside)
    # what holds the content element or the page's heading is a wrapper, whatever its class says
    heads = [i for i, e in enumerate(page) if not e.end and (e.name in ("main", "h1") or (e.name == "article" and e.never < 2))]
    out = []
    for i, j in close.items():
        e = page[i]
        if e.name in ("main", "body", "html") or (e.name == "article" and (e.never < 2 or len(contents) == 1)):
            continue
        outer = e.name in ("header", "footer") and not (e.name == "header" and any(a < i < b for a, b in inside))
        most = 2 * (before[j] - before[i]) > before[-1]
        holds = bisect_right(heads, j) > bisect_right(heads, i)
        marked = (e.never == 2 or (e.never == 1 and not most)) and (not holds or e.name == "article")
        wraps = bisect_right(contents, j) > bisect_right(contents, i)
        named = e.name in NEVER and not (e.name in _MAY_WRAP and (most or wraps))
        if e.name in only if only else named or outer or e.hidden or marked:
            out.append((i, j + 1))
    outer_most: list[tuple[int, int]] = []
    for i, j in sorted(out):
        if not outer_most or i >= outer_most[-1][1]:
            outer_most.append((i, j))
        elif j > outer_most[-1][1]:  # badly nested
            outer_most[-1] = (outer_most[-1][0], j)
    return outer_most


def extract(page: str, weights: Weights) -> str:
    """The main text of a page."""
    if not page:
        return ""
    tokens = events(page)
    gone, inside = _left_out(tokens), element(tokens)
    where, between = places(tokens, inside)
    scores = [weights.of(e, place) for e, place in zip(tokens, where)]
    for i in between:
        scores[i] = 0.0
    for i in range(*inside or (0, 0)):
        scores[i] = 0.0 if tokens[i].name else max(scores[i], LEAST_INSIDE * tokens[i].words)
    for i, j in gone:  # what such an element holds is no sign of content, nor of its end
        for k in range(i + 1, j):
            scores[k] = 0.0
    start, end = region(tokens, scores, gone)
    blocks: list[str] = []
    parts: list[str] = []
    k, until = 0, -1

    def close() -> None:
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(text)
        parts.clear()

    for i in range(end):
        while k < len(gone) and gone[k][0] <= i:
            until = max(until, gone[k][1])
            k += 1
        if i < start:
            continue
        e = tokens[i]
        if e.name in BLOCKS:
            close()
        elif i >= until:
            parts.append(e.text if not e.name else " " if e.name in ("br", "td", "th") else "")
    close()
    return "\n\n".join(blocks)


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE, longest: int = LONGEST) -> Weights:
    """Fit on at most `sample` labelled pages of at most `longest` characters."""
    rows = pages.select(F.xxhash64(F.lit(9), F.col(id_col), F.char_length(html_col)).alias("h"), F.col(html_col).cast("string").alias("html"))
    rows = rows.where((F.char_length("html") <= longest) & F.lower("html").rlike("<(article|main)[ >]"))
    n = rows.count()
    few = rows.where(F.shiftrightunsigned("h", 1).cast("double") / F.lit(float(1 << 63)) < min(1.0, (2.0 * sample + 20) / max(n, 1)))
    return fit([r["html"] for r in few.orderBy("h", "html").limit(sample).collect()])


def extract_pages(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: the id, url, text, n_chars."""
    weights = weights or learn(pages, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py() or "", weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
