"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text. A linear classifier over a block's text and form gives the cost of calling it content or
boilerplate: the capacity of its edge to a terminal. Adjacent blocks, and blocks that follow each other under the same
parent, are joined by edges that weigh the more the closer the two stand in the document tree, whatever their class
words and the elements around them are called. The minimum cut, found by maximum flow, separates content from boilerplate: a heading or a
short line goes with what it stands by. Blocks whose terminal edge outweighs all their others are settled beforehand,
which changes no cut.

The classifier's weights are a logistic regression that is drawn towards given weights (PRIOR). learn fits them to the
pages of a table that mark their article (an article or main element): their blocks are labelled by it, and the classifier
itself never sees that mark. What elements and class words say of a block's place is one more term, bounded and not
learned (see Place).

Defined results: a null or empty page has an empty text. Character references are decoded; white space in a block
becomes one space, its ends none; blocks are joined by one line feed in page order. Broken markup is read as browsers do
in the common cases: a block-level tag ends an open paragraph, an end tag without a start does nothing, an unclosed
comment, script or style, or a tag without an end, runs to the end of the page; only a quote that is never closed ends
with its tag. Reading takes time in proportion to the page, whatever it holds. Rows, repeats and further columns
stay; a column that has an added one's name gives way to it.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import small_batches

#: A tag from its name on: values in quotes may hold >. Possessive, so no character is read twice, but for one try to find
#: the end of a quote that has none.
TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")

#: Elements whose content is no markup; those of the first kind have text for no reader.
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img mi mn mo mrow msup msub mfrac msqrt mtext semantics".split())
#: Elements that draw or play, choose, or wait to be used: they have no text of the page.
UNSEEN = frozenset("template svg canvas object audio video select datalist annotation annotation-xml".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that an implied end does not reach beyond.
SCOPE = frozenset("ul ol dl table select article section div main body".split())

#: Elements and roles that hold no article, and class words that name readers' comments, what is sold or asked, and what
#: stands beside an article.
NEVER = frozenset("nav footer form button dialog menu fieldset".split())
ROLES = frozenset("navigation contentinfo complementary form search dialog alert alertdialog menu menubar banner".split())
COMMENTS = frozenset("comment comments commentlist respond disqus replies reply".split())
ASIDE = frozenset(
    "cookie cookies consent gdpr newsletter subscribe advert advertisement advertising adverts ads ad sponsor sponsored promo promotion popup modal breadcrumb breadcrumbs pagination "
    "nav navbar navigation menu sidebar side aside footer foot header masthead banner notice notices alert warning disclaimer share sharing social related recommended recommendations widget toolbar "
    "login signup search tags skip copyright legal teaser teasers".split()
)
CONTENT = frozenset("article content post entry main story body text".split())
#: Words that only say what part of a thing an element is, that an aside belongs to the article, and that the page has something elsewhere.
PART = frozenset("area article articles bar block body bottom box button buttons container content form icon icons inner item items left link links list main menu news panel post posts right section slot stories story top unit widget wrap wrapper".split())
WITHIN = frozenset("callout footnote footnotes note pullquote quote".split())
ELSEWHERE = frozenset("with without has no".split())
WORD = re.compile("[a-z]+")
CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


#: What an article or main element adds to the scores of its blocks.
ARTICLE = 4.5


@dataclass(frozen=True, slots=True)
class Place:
    """What the elements around a block say: a term of its score that is never over ARTICLE and never below -8."""

    for_: float = 0.0  # within an article or main element ARTICLE, within what class words call content less
    against: float = 0.0
    origin: int = 0  # number of the element that says the latter

    def term(self, heading: bool, wraps: bool) -> float:
        """A heading is hardly likelier in an article: it goes with what it stands by. What class words call a box beside
        the article is less likely to be one if it wraps over half of the page."""
        if self.against <= -4:
            return self.against if wraps or self.against <= -8 else -7.0
        return self.for_ / (6 if heading else 1) + self.against

    def within(self, other: Place, tag: str, number: int = 0) -> Place:
        """The place of an element of place self whose parent has the place other."""
        against = 0.0 if tag == "main" else max(other.against, -1.5) if tag == "article" and other.against == -4.25 else other.against
        own = self.against < against
        return Place(max(self.for_, other.for_), self.against if own else against, number if own else other.origin)


@lru_cache(4096)
def place(tag: str, attributes: str) -> tuple[Place, bool]:
    """What an element says of its place, and whether it is hidden."""
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    role = found.get("role", "").lower()
    if tag in ("html", "body", "head"):
        return Place(), hidden
    if tag in ("article", "main") or role in ("article", "main"):
        return Place(ARTICLE), hidden
    names = [WORD.findall(x) for x in CAMEL.sub("-", f"{found.get('class', '')} {found.get('id', '')}").lower().split()]
    words = {w for n in names for w in n}
    if tag in NEVER or role in ROLES:
        return Place(0.0, -8.0), hidden
    if tag == "aside" and not words & WITHIN:
        return Place(0.0, -8.0), hidden
    if tag == "header":
        return Place(0.0, 0.0 if words & CONTENT else -4.25), hidden
    against = 0.0
    for n in names:
        if not n or ELSEWHERE & set(n):
            continue
        if n[-1] in ("header", "banner", "footer") and len(n) > 1 and n[-2] in CONTENT and n[-1] == "header":  # holds the title
            continue
        for k, w in enumerate(n):
            if w in COMMENTS or w in ASIDE:
                whole = k == len(n) - 1 or (k == 0 and all(x in PART for x in n[1:]))
                against = min(against, (-5.5 if w in COMMENTS else -4.25) if whole else -1.5)
    return Place(1.75 if not against and words & CONTENT else 0.0, against), hidden


@dataclass(slots=True)
class Block:
    text: str
    tag: str  # of the block's own element
    parent: int  # number of the element that holds that element
    depth: int  # of its own element in the tree
    shared: int  # depth of the innermost element that holds this block and the one before
    place: Place
    hidden: bool
    linked: int  # characters within links


class Element:
    __slots__ = ("hidden", "number", "place", "scope", "tag", "unseen")

    def __init__(self, tag: str, number: int, at: Place, hidden: bool, unseen: bool, scope: int):
        self.tag, self.number, self.place, self.hidden, self.unseen, self.scope = tag, number, at, hidden, unseen, scope


class Blocks:
    """The blocks of a page, read once from its start to its end. For each tag the open elements are known, so no end tag
    searches for its start."""

    def __init__(self, page: str):
        self.out: list[Block] = []
        self.stack = [Element("", 0, Place(), False, False, 0)]
        self.open: dict[str, list[int]] = {}
        self.parts: list[str] = []
        self.numbers = self.linked = self.lowest = 0
        self.link = 0  # depth at which the open link began, 0 if none
        self.read(page)
        self.flush()

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            top = self.stack[-1]
            if text and not top.unseen:
                depth = len(self.stack)
                parent = self.stack[-2].number if depth > 1 else 0
                self.out.append(Block(text, top.tag, parent, depth, min(self.lowest, depth), top.place, top.hidden, min(self.linked, len(text))))
                self.lowest = depth
            self.parts.clear()
        self.linked = 0

    def pop(self, to: int) -> None:
        self.flush()
        for e in self.stack[to:]:
            self.open[e.tag].pop()
        del self.stack[to:]
        self.lowest = min(self.lowest, to)
        if self.link > to:
            self.link = 0

    def text(self, page: str, start: int, stop: int) -> None:
        if stop > start:
            text = page[start:stop]
            text = html.unescape(text) if "&" in text else text
            self.parts.append(text)
            if self.link:
                self.linked += len(text)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        elif tag == "br":
            self.parts.append(" ")
        elif tag not in INLINE:
            if found := self.open.get(tag):
                self.pop(found[-1])
            else:
                self.flush()

    def nearest(self, tag: str) -> int:
        """Where the innermost open element of this tag is, if no other of SCOPE stands within it; else 0."""
        found = self.open.get(tag)
        return found[-1] if found and found[-1] > self.stack[-1].scope else 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = len(self.stack) if "href" in attributes.lower() else 0
            return
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in INLINE:
            return
        if (tag in ENDS_P or tag == "body") and (head := self.open.get("head")):
            self.pop(head[0])
        if tag in ENDS_P and (k := self.nearest("p")):
            self.pop(k)
        elif tag in SAME:
            while k := max(map(self.nearest, SAME[tag])):
                self.pop(k)
                if tag != "tr":
                    break
        self.flush()
        above, (own, hidden) = self.stack[-1], place(tag, attributes)
        self.numbers += 1
        at = len(self.stack)
        if tag == "header" and above.place.for_ == ARTICLE:
            own = Place()  # an article's own header holds its title
        self.open.setdefault(tag, []).append(at)
        self.stack.append(Element(tag, self.numbers, own.within(above.place, tag, self.numbers), hidden or above.hidden, above.unseen or tag in UNSEEN, at if tag in SCOPE else above.scope))

    def read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            stop = page.find("<", at)
            if stop < 0:
                self.text(page, at, n)
                return
            m = TAG.match(page, stop + 1)
            if m:
                self.text(page, at, stop)
                at, tag = m.end(), m[2].lower()
                if m[1]:
                    self.end(tag)
                elif tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
                    at = end.end() if end else n
                    self.parts.append(" ")
                else:
                    self.start(tag, m[3])
                    if m[3].endswith("/") and tag in UNSEEN:
                        self.end(tag)
                continue
            first = page[stop + 1 : stop + 3]
            if first[:1] in ("!", "?") or (first[:1] == "/" and first[1:] and not first[1:].isspace()):
                self.text(page, at, stop)
                if page.startswith("<!--", stop):
                    if page.startswith(("<!-->", "<!--->"), stop):
                        end, size = page.find(">", stop), 1
                    else:
                        end, size = page.find("-->", stop + 4), 3
                else:
                    end, size = page.find(">", stop), 1
                at = n if end < 0 else end + size
            elif first[:1].isascii() and first[:1].isalpha():
                self.text(page, at, stop)  # a tag without an end
                return
            else:
                self.text(page, at, stop + 1)
                at = stop + 1


def blocks(page: str) -> list[Block]:
    return Blocks(page).out


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")

#: The classifier's features, and the weights that fitted ones are drawn towards.
FEATURES = ("always", "words", "sentence", "linked", "paragraph", "heading", "item", "rights", "hidden", "mass")
PRIOR = (-1.6, 0.6, 0.7, -3.0, 0.6, -0.8, -0.2, -2.0, -1.0, 2.5)

#: How close a fitted weight stays to the given one, and how many labelled blocks count as much as that.
DRAWN, WEIGHED = 8.0, 40.0

#: Bounds of the sample that weights are fitted on: pages, about, and blocks of each (spread over the page).
PAGES, BLOCKS = 400, 200


def features(found: list[Block]) -> list[tuple[float, ...]]:
    mass: dict[int, int] = {}
    words = [b.text.count(" ") + 1 for b in found]
    for b, n in zip(found, words, strict=True):
        mass[b.parent] = mass.get(b.parent, 0) + (n if 2 * b.linked <= len(b.text) else 0)
    out = []
    for b, n in zip(found, words, strict=True):
        linked, item = b.linked / len(b.text), float(b.tag in ("li", "td", "th", "dt", "dd", "option"))
        hidden = float(b.hidden)
        rights = float(n < 40 and ("©" in b.text or "all rights reserved" in b.text.lower()))
        if b.tag in HEADINGS:  # its own words say little
            out.append((0.0, 0.0, 0.0, linked / 4, 0.0, 1.0, 0.0, 0.0, hidden, 0.0))
        else:
            size, ends = min(math.log2(1 + n), 9.0), float(SENTENCE.search(b.text) is not None)
            out.append((1.0, size, ends, linked, float(b.tag in ("p", "pre", "blockquote")), 0.0, item, rights, hidden, min(math.log2(1 + mass[b.parent]), 9.0) / 9 - 0.5))
    return out


def scores(found: list[Block], weights: tuple[float, ...] = PRIOR) -> list[float]:
    """Above zero: content is likelier, by the classifier and the block's place."""
    held: dict[int, int] = {}
    for b in found:
        held[b.place.origin] = held.get(b.place.origin, 0) + len(b.text)
    half = sum(held.values()) / 2
    return [sum(map(float.__mul__, weights, x)) + b.place.term(b.tag in HEADINGS, held[b.place.origin] > half) for b, x in zip(found, features(found), strict=True)]


#: The blocks after a heading that may be what it stands by, and how much each counts.
AHEAD = (1.0, 0.75, 0.5)


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    """The weight of what joins two blocks, 2 at most, by the steps between them in the tree. A heading belongs to what
    follows more than to what it follows."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        after = b.tag in HEADINGS
        if i and found[i - 1].tag not in HEADINGS:
            weight = 32.0 / max(2, found[i - 1].depth + b.depth - 2 * b.shared) ** 4
            out[i - 1, i] = weight / 4 if after else weight
        if (j := last.get(b.parent)) is not None and j < i - 1:
            out[j, i] = 0.25 if after else 1.0
        last[b.parent] = i
        shared = b.depth
        for j, share in zip(range(i + 1, len(found)), AHEAD) if after else ():  # noqa: B905
            shared = min(shared, found[j].shared)
            out[i, j] = share * 8.0 / max(2, b.depth + found[j].depth - 2 * shared) ** 2
    return out


#: Capacities are whole numbers of this part.
UNIT = 64


def cut(costs: list[float], joined: dict[tuple[int, int], float]) -> list[bool]:
    """The labelling (True: content) of least cost: |cost| for each label against its sign, and the weight of each edge
    between unlike labels. A tie is boilerplate."""
    near: list[dict[int, int]] = [{} for _ in costs]
    for (i, j), w in joined.items():
        if i != j and (c := round(w * UNIT)) > 0:
            near[i][j] = near[i].get(j, 0) + c
            near[j][i] = near[j].get(i, 0) + c
    rest, label = [round(c * UNIT) for c in costs], [False] * len(costs)
    settled, queue = [False] * len(costs), deque(range(len(costs)))
    while queue:  # settle what its neighbours cannot turn
        i = queue.popleft()
        if settled[i] or abs(rest[i]) <= sum(near[i].values()) and near[i]:
            continue
        settled[i], label[i] = True, rest[i] > 0
        for j, w in near[i].items():
            rest[j] += w if label[i] else -w
            del near[j][i]
            queue.append(j)
        near[i] = {}
    left = [i for i in range(len(costs)) if not settled[i]]
    if left:
        for i in _source_side(left, rest, near):
            label[i] = True
    return label


def _source_side(left: list[int], rest: list[int], near: list[dict[int, int]]) -> list[int]:
    """What a maximum flow leaves within reach of the source: shortest paths of one length are all filled before longer
    ones are sought."""
    sink = -1
    flow: dict[int, dict[int, int]] = {i: dict(near[i]) for i in left}
    supply = {i: rest[i] for i in left if rest[i] > 0}
    for i in left:
        if rest[i] < 0:
            flow[i][sink] = -rest[i]
    while True:
        level = dict.fromkeys((i for i, c in supply.items() if c), 0)
        walk, ended = deque(level), False
        while walk:
            i = walk.popleft()
            for j, c in flow[i].items():
                if not c:
                    continue
                if j == sink:
                    ended = True
                elif j not in level and not ended:
                    level[j] = level[i] + 1
                    walk.append(j)
        if not ended:
            return list(level)
        ways, at = {i: list(flow[i]) for i in level}, dict.fromkeys(level, 0)
        for source in [i for i in level if level[i] == 0]:
            path = [source]
            while path and supply[source]:
                i = path[-1]
                if at[i] == len(ways[i]):
                    path.pop()
                    if path:
                        at[path[-1]] += 1
                    continue
                j = ways[i][at[i]]
                if not flow[i][j] or (j != sink and level.get(j) != level[i] + 1):
                    at[i] += 1
                    continue
                if j != sink:
                    path.append(j)
                    continue
                steps = list(zip(path, [*path[1:], sink], strict=True))
                most = min(supply[source], *(flow[x][y] for x, y in steps))
                supply[source] -= most
                for x, y in steps:
                    flow[x][y] -= most
                    if y != sink:
                        flow[y][x] = flow[y].get(x, 0) + most
                full = next((k for k, (x, y) in enumerate(steps) if not flow[x][y]), 0)
                del path[full + 1 :]


def weak_labels(found: list[Block]) -> list[tuple[tuple[float, ...], bool]]:
    """Features and label of blocks of a page that marks its article; none of other pages."""
    held = [b.place.for_ == ARTICLE and b.place.against > -4 for b in found]
    if not any(held):
        return []
    step = -(-len(found) // BLOCKS)
    kept = [(x, y) for b, x, y in zip(found, features(found), held, strict=True) if b.tag not in HEADINGS]  # they say little by themselves
    return kept[::step]


def fit(samples: list[tuple[tuple[float, ...], bool]]) -> tuple[float, ...]:
    """Weights of the greatest likelihood of the labels, drawn towards PRIOR; each label's samples weigh the same in all."""
    prior = np.array(PRIOR)
    w, x, y = prior.copy(), np.array([f for f, _ in samples], float).reshape(-1, len(PRIOR)), np.array([label for _, label in samples], bool)
    if y.all() or not y.any():
        return PRIOR
    share = np.where(y, 1 / y.sum(), 1 / (~y).sum()) * WEIGHED / 2
    for _ in range(25):  # Newton's steps; the penalty keeps them short
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + DRAWN * (w - prior)
        w = w - np.linalg.solve((x.T * (share * p * (1 - p))) @ x + DRAWN * np.eye(len(w)), slope)
    return tuple(np.round(w, 6).tolist())


def learn(pages: DataFrame, page: str = "html") -> tuple[float, ...]:
    """Weights fitted to a sample of about PAGES pages by hash, whole ones, of which those that mark their article count."""
    rows = pages.select(F.col(f"`{page}`").alias("page")).where("page is not null")
    total = pages.count()
    share = F.pmod(F.xxhash64("page"), F.lit(1 << 20)) < max(1, min(1 << 20, (PAGES << 20) // max(1, total)))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [s for p in batch.column(0).to_pylist() for s in weak_labels(blocks(p))]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in made], pa.list_(pa.float64())), pa.array([y for _, y in made], pa.bool_())], names=["x", "y"])

    small_batches(pages.sparkSession)
    found = rows.where(share).mapInArrow(over, "x array<double>, y boolean").limit(2 * PAGES * BLOCKS).collect()
    return fit(sorted((tuple(r["x"]), r["y"]) for r in found))


def main_text(page: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, kept in zip(found, cut(scores(found, weights), edges(found)), strict=True) if kept)


def extract(pages: DataFrame, page: str = "html", text: str = "text", weights: tuple[float, ...] | None = None) -> DataFrame:
    """pages with the main text, without the page itself. weights: see learn; those of PRIOR if none are given."""
    small_batches(pages.sparkSession)
    weights, columns = weights or PRIOR, [c for c in pages.columns if c not in (page, text)]
    given = pages.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{page}`").alias("__page"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), f"`{text}` string"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [main_text(p, weights) for p in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(done, pa.string())], names=[*columns, text])

    return given.mapInArrow(over, schema)
