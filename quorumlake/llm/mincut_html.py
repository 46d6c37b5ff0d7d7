"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks. Each is a node: a classifier's costs of calling it content or boilerplate are the capacities
of its edges to the two terminals; neighbours in the page and blocks near each other in the DOM are joined by smoothness edges.
The minimum cut, found by blocking flows, is the labelling of least total cost. Ties go to boilerplate.

The classifier is naive Bayes over features of a block's text and of the markup around it. It is fitted by expectation-maximisation
on a bounded sample of pages, starting from counts that stand for a few blocks of each kind: no label is given, so what a
class name or an element says is worth what it is worth in these pages. Neither text nor markup decides alone: each is
bounded, what is learned of markup may move it by LEARNED only, and blocks on which they differ go with their surroundings.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the classifier is fitted on, at most: those whose id has the least hash; rounds of expectation-maximisation.
FIT_PAGES, ROUNDS = 2_000, 6
#: Weight and bound of what the text says, bound of what the markup says, and capacities of edges between neighbours and between near blocks.
TEXT_WEIGHT, TEXT, MARKUP, NEXT, NEAR = 0.6, 3.0, 5.0, 2.0, 1.2
#: How far the log-odds of a kind of markup may go from where they start.
LEARNED = 1.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIP = frozenset("script style noscript template head title svg math iframe object canvas audio video map datalist".split())
BOILERPLATE = frozenset("nav footer aside form button select option textarea fieldset dialog menu input".split())
CONTENT = frozenset("article main".split())
BAD_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "pager pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
GOOD_NAMES = frozenset("article body content entry main post story text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu menubar alert".split())
#: Words that make a class name speak of the page, not of the element: has-sidebar, with-header, no-ads.
ABOUT = frozenset("has have with without no not is hide show body page layout wrapper".split())
#: Elements that may stand in a head; any other ends it.
HEAD = frozenset("head title meta link style script base noscript template".split())
#: Open tags of these kinds end when the next of them, or the block around them, begins or ends.
CLOSED_BY = {"p": INLINE, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What is seen of an element: these kinds of markup, the nearest of which holds for a block. Those of content:
GOOD_KINDS = frozenset(["article", "main"])


def _named(attrs: list[tuple[str, str | None]]) -> str | None:
    """What class and id say: name (a name of boilerplate), part (one among other words), None (nothing, or both this and content)."""
    found, good = set(), False
    for k, v in attrs:
        if k in ("class", "id") and v:
            for token in v.split():
                words = {w.lower() for w in _NAME.findall(token)}
                if words & BAD_NAMES and not words & ABOUT:
                    found.add("name" if words <= BAD_NAMES else "part")
                elif words and words <= GOOD_NAMES:
                    good = True
    return None if good or not found else "name" if "name" in found else "part"


def _kind(tag: str, attrs: list[tuple[str, str | None]], around: str) -> str | None:
    """The kind of markup that an element is, given the kind around it; None if it says nothing of its text."""
    given = dict(attrs)
    role = (given.get("role") or "").lower()
    if "hidden" in given or (given.get("aria-hidden") or "").lower() == "true":
        return "hidden"
    if role in ROLES:
        return "role"
    if tag in CONTENT or role in ("main", "article") or given.get("itemprop") == "articleBody":
        return "main" if "main" in (tag, role) else "article"
    if tag == "header":
        return None if around in GOOD_KINDS else "header"
    if tag in BOILERPLATE:
        return tag if tag in ("nav", "footer", "aside", "form") else "control"
    return None if tag in ("html", "body") else _named(attrs)


@dataclass
class Block:
    text: str
    tag: str
    parent: int  # number of the element around that of the block
    steps: int  # elements that are left and entered from the block before to this one
    kind: str
    linked: int = 0


@dataclass
class _Open:
    tag: str
    kind: str  # the nearest kind of markup, own or around
    number: int
    own: bool = False
    skip: bool = False


class _Blocks(HTMLParser):
    """Text between block elements, white space collapsed; character references decoded; scripts, styles and comments left out.

    Each element is opened and closed once and keeps what holds inside it, so that work grows with the page, not with its depth.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[_Open] = []
        self.outer: list[_Open] = []  # those of self.open that aren't inline
        self.tags: Counter = Counter()
        self.parts: list[str] = []
        self.linked = self.count = self.skipping = self.links = 0
        self.depth = self.low = 0  # of the block before, and the least since then

    def _end_block(self):
        text = " ".join("".join(self.parts).split())
        if text:
            at = len(self.outer)
            low = min(self.low, at)
            steps = self.depth + at - 2 * low
            self.blocks.append(Block(text, self.outer[-1].tag if at else "body", self.outer[-2].number if at > 1 else -1, steps, self.open[-1].kind if self.open else "none", min(self.linked, len(text))))
            self.depth = self.low = at
        self.parts, self.linked = [], 0

    def _pop(self):
        x = self.open[-1]
        if x.tag not in INLINE or x.own:
            self._end_block()
        self.open.pop()
        if x.tag not in INLINE:
            self.outer.pop()
            self.low = min(self.low, len(self.outer))
        self.tags[x.tag] -= 1
        self.skipping -= x.skip
        self.links -= x.tag == "a"

    def _close(self, tag: str):
        while self.open[-1].tag != tag:
            self._pop()
        self._pop()

    def handle_starttag(self, tag, attrs):
        if self.tags["head"] and tag not in HEAD and self.skipping == self.tags["head"]:
            self._close("head")
        if tag not in INLINE:
            self._end_block()
            # unclosed inline elements don't reach over block boundaries; p, li and the like end before their next
            while self.open and self.open[-1].tag in INLINE:
                self._pop()
            if self.open and (self.open[-1].tag == "p" or self.open[-1].tag in CLOSED_BY.get(tag, ())):
                self._pop()
        elif tag in ("br", "wbr"):
            self.parts.append(" " if tag == "br" else "")
        if tag in VOID:
            return
        around = self.open[-1].kind if self.open else "none"
        kind = _kind(tag, attrs, around)
        if kind and tag in INLINE:
            # an inline element that says what it is is a block of its own
            self._end_block()
        self.open.append(_Open(tag, kind or around, self.count, kind is not None, tag in SKIP))
        if tag not in INLINE:
            self.outer.append(self.open[-1])
        self.tags[tag] += 1
        self.count += 1
        self.skipping += tag in SKIP
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # in HTML a slash does not close

    def handle_endtag(self, tag):
        if self.tags[tag]:
            self._close(tag)
        elif tag == "p":
            self._end_block()

    def handle_data(self, data):
        if not self.skipping:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self):
        super().close()
        while self.open:
            self._pop()
        self._end_block()


def blocks(html: str | None) -> list[Block]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    return parser.blocks


def features(b: Block, in_article: bool) -> tuple[str, ...]:
    """The last is the markup; in_article: whether the page has an article or main part, which tells on what stands outside of it."""
    n, words = len(b.text), b.text.count(" ") + 1
    density = b.linked / n
    stops = sum(b.text.count(x) for x in ".!?;,")
    return (
        f"words:{min(words, 200).bit_length()}",
        f"links:{0 if density < 0.1 else 1 if density < 0.5 else 2}",
        f"stops:{0 if not stops else 1 if stops * 25 < words else 2}",
        f"ends:{b.text[-1] in '.!?…”"'}",
        f"tag:{b.tag if b.tag in ('p', 'li', 'td', 'div', 'span', 'blockquote', 'pre') else 'h' if b.tag in ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') else 'other'}",
        f"marks:{'|' in b.text or '©' in b.text or '»' in b.text}",
        f"kind:{'outside' if b.kind == 'none' and in_article else b.kind}",
    )


#: Counts (content, boilerplate) that stand in for a few blocks of each kind before any page is seen.
PRIOR = {"links:2": (1, 30), "links:0": (30, 15), "words:1": (1, 10), "words:2": (2, 10), "words:3": (4, 8), "words:5": (12, 4), "words:6": (16, 2), "words:7": (16, 1), "words:8": (16, 1), "stops:0": (4, 25), "stops:2": (30, 6), "ends:True": (30, 8), "ends:False": (6, 25), "tag:p": (30, 6), "tag:li": (4, 14), "tag:h": (40, 4), "marks:True": (1, 6)}
#: The same of kinds of markup.
KINDS = {"article": (200, 2), "main": (80, 2), "none": (20, 20), "outside": (5, 30), "nav": (1, 120), "footer": (1, 120), "aside": (1, 120), "control": (1, 120), "hidden": (1, 120), "role": (1, 120), "name": (1, 120), "part": (2, 30), "header": (2, 40), "form": (8, 24)}


def _bounded(text: np.ndarray | float, markup: np.ndarray | float):
    return np.clip(TEXT_WEIGHT * text, -TEXT, TEXT) + np.clip(markup, -MARKUP, MARKUP)


@dataclass
class Classifier:
    """Log-odds of content for each feature."""

    odds: dict[str, float] = field(default_factory=lambda: _odds({}))

    def __call__(self, seen: tuple[str, ...]) -> float:
        return float(_bounded(sum(self.odds.get(f, 0.0) for f in seen[:-1]), self.odds.get(seen[-1], 0.0)))


def _odds(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Of a feature of the text how often each class has it, of those of one group; of markup how often it is of each class."""
    n = {k: list(v) for k, v in (PRIOR | {f"kind:{k}": v for k, v in KINDS.items()}).items()}
    groups: dict[str, list[float]] = {}
    for f, (yes, no) in counts.items():
        had = n.setdefault(f, [0, 0])
        had[0] += yes
        had[1] += no
    for f, (yes, no) in n.items():
        g = groups.setdefault(f.split(":")[0], [0, 0])
        g[0] += yes
        g[1] += no
    out = {}
    for f, (yes, no) in n.items():
        g = groups[f.split(":")[0]]
        out[f] = float(np.log((yes + 1) / (g[0] + 8)) - np.log((no + 1) / (g[1] + 8)))
    for k, (yes, no) in KINDS.items():
        start, now = np.log((yes + 1) / (no + 1)), np.log((n[f"kind:{k}"][0] + 1) / (n[f"kind:{k}"][1] + 1))
        out[f"kind:{k}"] = float(start + np.clip(now - start, -LEARNED, LEARNED))
    return out


def maximise(seen: list[tuple[tuple[str, ...], int]], rounds: int = ROUNDS) -> Classifier:
    """The classifier from (features of a block, how often): each round weighs every block by how likely it is content so far."""
    names = sorted({f for x, _ in seen for f in x})
    place = {f: i for i, f in enumerate(names)}
    at = np.array([[place[f] for f in x] for x, _ in seen], int).reshape(len(seen), -1)
    times = np.array([n for _, n in seen], float)
    model = Classifier()
    for _ in range(rounds if len(seen) else 0):
        w = np.array([model.odds.get(f, 0.0) for f in names])
        p = 1 / (1 + np.exp(-_bounded(w[at[:, :-1]].sum(1), w[at[:, -1]])))
        yes, no = (np.bincount(at.ravel(), np.repeat(times * q, at.shape[1]), len(names)) for q in (p, 1 - p))
        model = Classifier(_odds({f: (yes[i], no[i]) for i, f in enumerate(names)}))
    return model


def _seen(page: list[Block]) -> list[tuple[str, ...]]:
    inside = any(b.kind in GOOD_KINDS for b in page)
    return [features(b, inside) for b in page]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Classifier:
    """The classifier of at most FIT_PAGES pages. Only counts of combined features come to the driver, some 50,000 at most."""

    def count(batches):
        tally: Counter = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                tally.update(" ".join(x) for x in _seen(blocks(html)))
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["seen", "n"])

    ids = pages.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(id_col).cast("string").alias("id")).orderBy("h", "id").limit(FIT_PAGES)
    last = ids.agg(F.max("h")).first()[0]
    if last is None:
        return Classifier()
    sample = pages.filter(F.xxhash64(F.col(id_col).cast("string")) <= last).select(F.col(html_col).cast("string").alias("html")).limit(FIT_PAGES)
    tally = sample.mapInArrow(count, "seen string, n bigint").groupBy("seen").agg(F.sum("n").alias("n")).orderBy("seen").collect()
    return maximise([(tuple(r.seen.split(" ")), r.n) for r in tally])


def edges(page: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: between neighbours, more if the DOM has them near; and between a block and the next of the same parent."""
    out, last = [], {}
    for i, b in enumerate(page):
        if i:
            out.append((i - 1, i, NEXT / (1 + b.steps)))
        if b.parent in last:
            out.append((last[b.parent], i, NEAR / (i - last[b.parent])))
        last[b.parent] = i
    return out


def _source_side(pull: dict[int, float], near: list[dict[int, float]]) -> set[int]:
    """The nodes that stay with the source in the minimum cut of one connected part, by maximum flow in blocking flows (Dinic)."""
    cap = {u: dict(near[u]) for u in pull}
    into = {u: max(x, 0.0) for u, x in pull.items()}  # what the source can still send to a node, and a node to the sink
    out = {u: max(-x, 0.0) for u, x in pull.items()}
    while True:
        level = {u: 0 for u in pull if into[u] > 1e-9}
        queue = deque(level)
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if not any(out[u] > 1e-9 for u in level):
            return set(level)
        ahead, at = {u: list(cap[u]) for u in level}, dict.fromkeys(level, 0)
        for s in [u for u, x in level.items() if x == 0]:
            path = [s]
            while path:
                u = path[-1]
                if into[s] <= 1e-9:
                    break
                if out[u] > 1e-9:
                    steps = list(zip(path, path[1:], strict=False))
                    flow = min([into[s], out[u], *[cap[a][b] for a, b in steps]])
                    into[s] -= flow
                    out[u] -= flow
                    for a, b in steps:
                        cap[a][b] -= flow
                        cap[b][a] = cap[b].get(a, 0.0) + flow
                    path = path[: next((i + 1 for i, (a, b) in enumerate(steps) if cap[a][b] <= 1e-9), len(path))]
                    continue
                while at[u] < len(ahead[u]) and not (cap[u][ahead[u][at[u]]] > 1e-9 and level.get(ahead[u][at[u]]) == level[u] + 1):
                    at[u] += 1
                if at[u] < len(ahead[u]):
                    path.append(ahead[u][at[u]])
                else:
                    level[u] = -1  # nothing more goes through here
                    path.pop()


def minimum_cut(content: list[float], boiler: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the content terminal. content[i], boiler[i]: capacity from the content and to the boilerplate terminal.

    Nodes whose terminals differ by more than all their edges hold have their label in every minimum cut; they are fixed first.
    Maximum flow labels the parts that are left.
    """
    n = len(content)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in joined:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    pull = [c - b for c, b in zip(content, boiler, strict=True)]
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(pull[i]) > sum(near[i].values()):
            label[i] = pull[i] > 0
            for j, c in near[i].items():
                pull[j] += c if label[i] else -c
                near[j].pop(i)
                todo.append(j)
            near[i] = {}
    for i in range(n):
        if label[i] is None:
            part, queue = {i: pull[i]}, deque([i])
            while queue:
                for j in near[queue.popleft()]:
                    if j not in part:
                        part[j] = pull[j]
                        queue.append(j)
            stay = _source_side(part, near)
            for j in part:
                label[j] = j in stay
    return [bool(x) for x in label]


def labelled(html: str | None, classify: Classifier) -> list[tuple[Block, float, bool]]:
    """(block, cost of leaving it out less that of keeping it, whether it is kept)."""
    page = blocks(html)
    cost = [classify(x) for x in _seen(page)]
    keep = minimum_cut([max(s, 0.0) for s in cost], [max(-s, 0.0) for s in cost], edges(page))
    return list(zip(page, cost, keep, strict=True))


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages with `text`: their content blocks in page order, one a line.

    White space in a block, br included, is one space. Null and empty pages, and those without content, have an empty text. A block
    whose two labels cost the same is left out. Repeated rows come back repeated, an empty table gives no rows; a column named text is replaced.
    """
    classify = fit(pages, id_col, html_col)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array(["\n".join(b.text for b, _, kept in labelled(x, classify) if kept) for x in column.to_pylist()], pa.string())

    return pages.withColumn("text", text(F.col(html_col).cast("string")))
