"""Main text of web pages by wrapper induction.

A page is a tree of block elements whose leaves are runs of text; equal siblings in a row fold into one. Pages of a
host are aligned by simple tree matching (the ordered matching of children with most matched nodes) into the host's template, whose
text slots know on what share of the pages each of their texts stands. What nearly all pages agree on is template, wherever it stands;
what varies is content. Where varying slots compete, the page's own words break the tie: an article before what is around it,
and nothing from an element that calls itself a menu, advert, footer and the like. Templates are induced in each partition, merged
by host in a tree, and joined to the pages.
"""

from __future__ import annotations

import html as markup
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a new element closes, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that aren't part of an article.
ASIDE_TAGS = frozenset("nav aside footer form button head menu dialog fieldset object embed canvas".split())
#: Words that say so in class, id and role, if a name is nothing else; outside an article also as part of a name.
ASIDE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer comment comments respond reply disqus cookie cookies consent notice notices alert gdpr popup modal overlay subscribe subscription newsletter signup share sharing social related recommended widget toolbar".split())
#: The same outside an article only.
OUTER = frozenset("header search login skip".split())
MAIN_TAGS = frozenset({"article", "main"})
#: A text that stands in a slot on this share of the pages that have the slot is template, if these are so many pages (more in an
#: article) and such a share of the host's pages; copies of a page have one vote together.
AGREE, LEAST, LEAST_MAIN, LEAST_SHARE = 0.9, 2, 5, 0.2
#: A template forgets texts that fewer of its pages have, once it holds so many.
FORGET, MANY = 0.5, 4096
#: Elements nested deeper are children of the one at this depth; names and regions know the real nesting.
DEEP = 120
#: Cells of an alignment table; longer rows of children are aligned half by half.
CELLS = 1 << 22
#: Partial templates of a host that meet in one task.
FAN = 32
#: Templates of all hosts together, and ids of repeated pages, up to these sizes are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES, BROADCAST_COPIES = 8 << 20, 200_000


class Text:
    __slots__ = ("order", "region", "text")

    def __init__(self, order: int, region: str, text: str):
        self.order, self.region, self.text = order, region, text


def region_of(tag: str, names: set[str], around: str) -> str:
    """`main` in an article, `aside` in what names itself none of it, else empty."""
    if around == "aside" or tag in ASIDE_TAGS or names & ASIDE_NAMES:
        return "aside"
    if around == "main":
        return "main"
    parts = {w for n in names for w in re.findall(r"[a-z]+", n)}
    if parts & (ASIDE_NAMES | OUTER) or tag in OUTER:
        return "aside"
    return "main" if tag in MAIN_TAGS or "main" in parts else ""


class Open:
    """The open elements of a page: names, regions and tree nodes, with what is asked of them often at hand."""

    def __init__(self, root: list):
        self.names, self.regions, self.nodes = [""], [""], [root]
        self.count: Counter = Counter()
        self.paragraphs: list[int] = []
        self.holders: list[int] = []

    def push(self, tag: str, label: str, region: str) -> None:
        node = [label, []]
        self.nodes[min(len(self.nodes), DEEP) - 1][1].append(node)
        if tag == "p":
            self.paragraphs.append(len(self.names))
        elif tag in ("td", "th", "li", "div", "article", "section"):
            self.holders.append(len(self.names))
        self.names.append(tag)
        self.regions.append(region)
        self.nodes.append(node)
        self.count[tag] += 1

    def cut(self, k: int) -> None:
        """Closes everything from place k on."""
        self.count.subtract(self.names[k:])
        del self.names[k:], self.regions[k:], self.nodes[k:]
        for places in (self.paragraphs, self.holders):
            while places and places[-1] >= k:
                places.pop()

    def nearest(self, ends: set[str], bounds: set[str] = frozenset()) -> int:
        """Place of the innermost element of `ends` that no element of `bounds` shields; 0 if there is none."""
        if any(self.count[t] for t in ends):
            for k in range(len(self.names) - 1, 0, -1):
                if self.names[k] in ends:
                    return k
                if self.names[k] in bounds:
                    break
        return 0


def parse(page: str) -> list:
    """[label, children] of the page's block elements; children are elements or Text. Unclosed elements end with their parents."""
    root: list = ["", []]
    open_ = Open(root)
    run: list[str] = []
    order = at = 0

    def flush() -> None:
        nonlocal order
        text = "".join(run)
        run.clear()
        if "&" in text:
            text = markup.unescape(text)
        text = " ".join(text.split())
        if text:
            open_.nodes[-1][1].append(Text(order, open_.regions[-1], text))
            order += 1

    for m in TOKEN.finditer(page):
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag in ("br", "img", "input"):
                run.append(" ")
            continue
        flush()
        if m.group(2):
            if k := open_.nearest({tag}):
                open_.cut(k)
            continue
        if tag in ENDS_P and open_.paragraphs and not (open_.holders and open_.holders[-1] > open_.paragraphs[-1]):
            open_.cut(open_.paragraphs[-1])
        if tag in CLOSES and (k := open_.nearest(*CLOSES[tag])):
            open_.cut(k)
        if tag in VOID:
            continue
        names = {w for g in NAMES.findall(m.group(4)) for w in "".join(g).lower().split()} if "=" in m.group(4) else set()
        found = sorted({w for n in names for w in re.findall(r"[a-z]+", n)})
        open_.push(tag, ".".join([tag, *found]), region_of(tag, names, open_.regions[-1]))
    run.append(page[at:])
    flush()
    return root


class Shapes:
    """Numbers for tree shapes: equal trees have one number. A shape is a label with the numbers of its children."""

    def __init__(self):
        self.of: dict[tuple, int] = {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.memo: dict[tuple[int, int], int] = {}

    def number(self, label: str, kids: tuple[int, ...] = ()) -> int:
        n = self.of.setdefault((label, kids), len(self.label))
        if n == len(self.label):
            self.label.append(label)
            self.kids.append(kids)
            self.size.append(1 + sum(self.size[k] for k in kids))
        return n

    def fold(self, node: list) -> tuple[int, list[list[Text]]]:
        """Shape and the texts of its slots, in order; equal neighbours fold into one child."""
        shapes: list[int] = []
        slots: list[list[list[Text]]] = []
        for kid in node[1]:
            shape, mine = (self.number("#" + kid.region), [[kid]]) if isinstance(kid, Text) else self.fold(kid)
            if shapes and shapes[-1] == shape:
                for a, b in zip(slots[-1], mine):
                    a += b
            else:
                shapes.append(shape)
                slots.append(mine)
        return self.number(node[0], tuple(shapes)), [x for y in slots for x in y]

    def weight(self, a: int, b: int) -> int:
        """Most matched nodes of two trees whose roots match; 0 if these don't."""
        if a == b:
            return self.size[a]
        if self.label[a] != self.label[b]:
            return 0
        if (a, b) not in self.memo:
            self.memo[a, b] = 1 + (self.matched(self.kids[a], self.kids[b]) if self.kids[a] and self.kids[b] else 0)
        return self.memo[a, b]

    def _ends(self, xs, ys) -> tuple[int, int]:
        """Equal children at both ends; to pair them is never worse than another matching."""
        n, front, back = min(len(xs), len(ys)), 0, 0
        while front < n and xs[front] == ys[front]:
            front += 1
        while back < n - front and xs[-1 - back] == ys[-1 - back]:
            back += 1
        return front, back

    def _rows(self, xs, ys) -> Iterator[np.ndarray]:
        """Rows of the alignment table: most matched nodes of the first i of xs and the first j of ys."""
        kinds, column = np.unique(np.array(ys), return_inverse=True)
        held: dict[int, np.ndarray] = {}
        row = np.zeros(len(ys) + 1, dtype=np.int64)
        yield row
        for x in xs:
            if x not in held:
                held[x] = np.array([self.weight(x, y) for y in kinds.tolist()], dtype=np.int64)
            row = np.concatenate([[0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + held[x][column]))])
            yield row

    def matched(self, xs, ys) -> int:
        """Most matched nodes over ordered children."""
        front, back = self._ends(xs, ys)
        total = sum(self.size[x] for x in xs[:front]) + sum(self.size[x] for x in xs[len(xs) - back :])
        xs, ys = xs[front : len(xs) - back], ys[front : len(ys) - back]
        if xs and ys:
            for row in self._rows(xs, ys):
                pass
            total += int(row[-1])
        return total

    def pairs(self, xs, ys) -> list[tuple[int, int]]:
        """Places of the matched children."""
        front, back = self._ends(xs, ys)
        out = [(i, i) for i in range(front)]
        n, m = len(xs) - back, len(ys) - back
        out += [(front + i, front + j) for i, j in self._inner(xs[front:n], ys[front:m])]
        return out + [(n + i, m + i) for i in range(back)]

    def _inner(self, xs, ys) -> list[tuple[int, int]]:
        if not xs or not ys:
            return []
        if len(xs) * len(ys) > CELLS and len(xs) > 1:
            half = len(xs) // 2
            for head in self._rows(xs[:half], ys):
                pass
            for tail in self._rows(xs[:half - 1 : -1], ys[::-1]):
                pass
            k = int(np.argmax(head + tail[::-1]))
            return self._inner(xs[:half], ys[:k]) + [(half + i, k + j) for i, j in self._inner(xs[half:], ys[k:])]
        best = list(self._rows(xs, ys))
        out, i, j = [], len(xs), len(ys)
        while i and j:
            w = self.weight(xs[i - 1], ys[j - 1])
            if w and best[i][j] == best[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out[::-1]


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


class Template:
    """A host's tree: nodes [label, children, slot number or None]; for each slot the pages that have it, the texts on them,
    and for each text the pages that have it there. Pages count by weight, a copy for its share of the copies."""

    def __init__(self, shapes: Shapes, tree=None, slots=None, pages: float = 0.0):
        self.shapes, self.tree, self.slots, self.pages = shapes, tree or ["", [], None], slots or [], pages
        self.known: dict[int, list[int]] = {}

    def dump(self) -> str:
        for s in self.slots:
            self._forget(s, 0)
        return json.dumps([self.tree, [[n, m, list(t.items())] for n, m, t in self.slots], self.pages])

    @classmethod
    def load(cls, shapes: Shapes, text: str) -> Template:
        tree, slots, pages = json.loads(text)
        return cls(shapes, tree, [[n, m, dict(map(tuple, t))] for n, m, t in slots], pages)

    @staticmethod
    def _forget(slot: list, most: int) -> None:
        if len(slot[2]) > most:
            slot[2] = {h: w for h, w in slot[2].items() if w >= FORGET * slot[0]}

    def place(self, shape: int, grow: bool) -> list[int]:
        """Slot number for each slot of a shape, by simple tree matching; -1 where it has none and mustn't grow."""
        found = self.known.get(shape)
        if found is None:
            found, before = [], len(self.slots)
            self._align(self.tree, shape, grow, found)
            if len(self.slots) > before:
                self.known.clear()
            self.known[shape] = found
        return found

    def _shape(self, node: list) -> int:
        return self.shapes.number(node[0], tuple(map(self._shape, node[1])))

    def _align(self, node: list | None, shape: int, grow: bool, out: list[int]) -> None:
        label, kids = self.shapes.label[shape], self.shapes.kids[shape]
        if label.startswith("#"):
            out.append(-1 if node is None else node[2])
            return
        pairs = self.shapes.pairs(tuple(map(self._shape, node[1])), kids) if node and node[1] else []
        partner = {j: node[1][i] for i, j in pairs}
        merged: list[list] = []
        next_ = 0  # of the template's children, those up to the last partner are in `merged`
        places = {id(x): i for i, x in enumerate(node[1])} if node and grow else {}
        for j, kid in enumerate(kids):
            mate = partner.get(j)
            if grow and mate is None:
                mate = [self.shapes.label[kid], [], None]
                if mate[0].startswith("#"):
                    mate[2] = len(self.slots)
                    self.slots.append([0.0, 0.0, {}])
                merged.append(mate)
            elif grow:
                merged += node[1][next_ : places[id(mate)] + 1]
                next_ = places[id(mate)] + 1
            self._align(mate, kid, grow, out)
        if grow:
            node[1] = merged + node[1][next_:]

    def learn(self, shape: int, texts: list[list[Text]], weight: float) -> None:
        self.pages += weight
        for slot, mine in zip(self.place(shape, True), texts):
            s = self.slots[slot]
            s[0], s[1] = s[0] + weight, s[1] + weight * len(mine)
            for h in {text_hash(t.text) for t in mine}:
                s[2][h] = s[2].get(h, 0.0) + weight
            self._forget(s, MANY)

    def absorb(self, other: Template) -> None:
        """Merges another template of the same host."""
        numbers: list[int] = []

        def shape(node: list) -> int:
            if node[2] is not None:
                numbers.append(node[2])
            return self.shapes.number(node[0], tuple(map(shape, node[1])))

        made = shape(other.tree)
        self.pages += other.pages
        for mine, theirs in zip(self.place(made, True), numbers):
            a, b = self.slots[mine], other.slots[theirs]
            a[0], a[1] = a[0] + b[0], a[1] + b[1]
            for h, w in b[2].items():
                a[2][h] = a[2].get(h, 0.0) + w
            self._forget(a, MANY)

    def decide(self) -> Template:
        """Keeps of each slot what nearly all pages agree on, and whether it is all that the slot ever has."""
        labels: dict[int, str] = {}

        def walk(node: list) -> None:
            if node[2] is not None:
                labels[node[2]] = node[0]
            for kid in node[1]:
                walk(kid)

        walk(self.tree)
        for k, s in enumerate(self.slots):
            n, main = s[0] + 1e-6, labels.get(k) == "#main"
            enough = n >= (LEAST_MAIN if main else LEAST) and n >= LEAST_SHARE * self.pages
            s[2] = {h: w for h, w in s[2].items() if enough and w >= AGREE * s[0] - 1e-6}
            s[1] = float(bool(s[2]) and not main and s[1] <= 1.05 * s[0])
        return self


def content(template: Template | None, shape: int, texts: list[list[Text]]) -> list[Text]:
    """The texts of a page that are content, in page order."""
    slots = template.place(shape, False) if template else [-1] * len(texts)
    kept, main, dropped = [], [], []
    for slot, mine in zip(slots, texts):
        _, whole, agreed = template.slots[slot] if slot >= 0 else (0, 0, ())
        for t in mine:
            same = whole or (agreed and text_hash(t.text) in agreed)
            (dropped if same else main if t.region == "main" else kept).append(t)
    if not main:  # an article that is the same on all pages is an article still
        main = [t for t in dropped if t.region == "main"]
    return sorted(main or [t for t in kept if t.region != "aside"], key=lambda t: t.order)


def induce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shapes, found = Shapes(), {}
    dump = lambda: pd.DataFrame([(h, t.dump()) for h, t in found.items()], columns=["host", "template"])
    for pdf in batches:
        for host, page, weight in zip(pdf["host"], pdf["html"], pdf["weight"]):
            if isinstance(page, str) and page:
                if host not in found:
                    found[host] = Template(shapes)
                found[host].learn(*shapes.fold(parse(page)), float(weight))
        if len(found) > 10_000 or len(shapes.label) > 300_000 or len(shapes.memo) > 1_000_000:  # templates of a host meet again when they are merged
            yield dump()
            shapes, found = Shapes(), {}
    yield dump()


def absorb_all(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shapes = Shapes()
        first, *rest = sorted(pdf["template"])
        whole = Template.load(shapes, first)
        for x in rest:
            whole.absorb(Template.load(shapes, x))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "template": [(whole.decide() if last else whole).dump()]})

    return run


def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shapes, held = Shapes(), {}
    for pdf in batches:
        out = []
        for template, page in zip(pdf["template"], pdf["html"]):
            text = ""
            if isinstance(page, str) and page:
                key = template if isinstance(template, str) else ""
                if len(held) > 1000 or len(shapes.label) > 300_000 or len(shapes.memo) > 1_000_000:
                    shapes, held = Shapes(), {}
                if key not in held:
                    held[key] = Template.load(shapes, key) if key else None
                text = "\n".join(t.text for t in content(held[key], *shapes.fold(parse(page))))
            out.append(text)
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": out, "n_chars": [len(x) for x in out]})


def host_templates(rows: DataFrame) -> DataFrame:
    """host and template for rows (host, html)."""
    copies = rows.groupBy("host", F.xxhash64("html").alias("h")).agg(F.count("*").alias("n")).filter("n > 1")
    copies = materialise(copies, "copies")
    few = copies.count() <= BROADCAST_COPIES
    voting = rows.withColumn("h", F.xxhash64("html")).join(F.broadcast(copies) if few else copies, ["host", "h"], "left")
    voting = voting.select("host", "html", (1 / F.coalesce("n", F.lit(1))).alias("weight"))
    parts = materialise(voting.mapInPandas(induce, "host string, template string"), "partial-templates")
    most = parts.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    while True:
        groups = math.ceil(most / FAN)
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(groups)))
        parts = materialise(salted.groupBy("host", "salt").applyInPandas(absorb_all(groups == 1), "host string, template string"), "templates")
        if groups == 1:
            return parts
        most = groups


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by a line feed; empty if none) and n_chars for every row of `pages`.

    Null and empty html give the empty text. Pages with a null url share one nameless host. Repeated rows and null
    ids give a row each; an empty table gives none; other columns are ignored, whatever their names.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", host.alias("host"))
    templates = host_templates(rows.select("host", "html"))
    small = (templates.agg(F.sum(F.octet_length("template"))).first()[0] or 0) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(templates) if small else templates, "host", "left")
    got = joined.select("page_id", "url", "html", "template").mapInPandas(extract, "page_id string, url string, text string, n_chars long")
    return got.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
