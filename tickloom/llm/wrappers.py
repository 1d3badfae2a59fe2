"""HTML extraction: wrappers of same-host pages, inferred as union-free regular expressions, say where the main text is.

A page becomes a stream of tags and texts, and this a tree of its block elements. Within a page equal neighbours (and equal
neighbouring sequences of up to three) fold into repeated groups. Trees of one host are aligned one by one: elements
match by name and class, a text that differs becomes a slot, an element that only one side has becomes optional, a group
that one side repeats is repeated. No step makes a union, so a wrapper stays about as large as one page. Each task aligns
the pages it reads before anything is shuffled; what tasks found for a host is aligned in up to FANIN parts, and those
with each other. A host with a third of all pages is so aligned in many tasks.

The wrapper of a host names the element that holds the running text: the deepest one that keeps most of what the slots
hold, boilerplate left out, and whether articles repeat on a page. `main_text` uses it where a page doesn't mark its article
itself. Texts inside the main element are never dropped for being the same on many pages.

Null and empty pages have an empty text; broken markup is read as browsers do in the main points (implied ends, raw script
text, a tag cut off at the end is no text); very long pages are read whole; repeated pages count twice in a wrapper; other
columns pass through.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Generator, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import parked
from tickloom.llm.urls import host_of

FANIN = 16
# Element names by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
HIDDEN = frozenset("script style textarea title noscript template iframe nav footer aside form button select option svg canvas object dialog menu head audio video map datalist label input".split())
BLOCKS = frozenset(
    "html body div section article main header footer nav aside form ul ol li dl dt dd table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 "
    "blockquote pre figure figcaption address fieldset details summary hr center hgroup search dialog menu".split()
)
# Elements that stand in a head and begin no body.
IN_HEAD = frozenset("head title meta link style script base noscript template".split())
# A start tag of the key ends an open element of the value.
_CELL = ("td", "th")
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", *_CELL), "td": _CELL, "th": _CELL, "tbody": ("tbody", "thead", "tr", *_CELL), "option": ("option",)}
SCOPES = frozenset("html body article main section div ul ol dl table td th header footer nav aside form blockquote figure".split())
# Words in a class or id that name boilerplate, and those that name the main text.
BOILERPLATE = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|sidebar|side|footer|header|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|respond|reply|replies|pagination|pager|skip|toolbar|widget|login|search\w*|copyright|legal|disclaimer)(?:$|[-_ ])",
    re.I,
)
# Words of a class that says how its element is laid out; such a class names no boilerplate.
LAYOUT = frozenset("no not has with without layout hide show".split())
# Within an article, boilerplate is a class or id that begins or ends with one of the first words or is one of the second.
INSERTED = re.compile(r"ad|ads|advert\w*|sponsor\w*|promo|promos|promotions?|cookies?|consent|gdpr|newsletter|subscribe|subscription|signup|share|sharing|related|recommend\w*|comments?|commentlist|disqus|respond|pagination|pager|breadcrumbs?|nav|navbar|navigation|sidebar|popup|modal", re.I)
INSERTED_WHOLE = frozenset("menu banner social notice notices widget toolbar login search footer side reply replies skip overlay".split())
MAIN = re.compile(r"(?:^|[-_ ])(?:main|content|article|post|entry|story|body-?text|text-?body)(?:$|[-_ ])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("start", name, attributes), ("end", name, "") and ("text", characters, "")."""
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name:
            if m[5] and m[7] == "":
                return  # cut off inside a tag
            name = name.lower()
            if m[1] or m[4]:
                yield "end", name, ""
                continue
            yield "start", name, (m[3] if m[2] else m[6]) or ""
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = close.start() if close else size
        elif not m[0].startswith(("<!", "<?")):
            yield "text", m[0], ""


@lru_cache(1 << 14)
def names_boilerplate(value: str, in_article: bool) -> bool:
    """Whether a class or id names boilerplate. Inside an article few names do, and never as a part in the middle."""
    for mark in value.lower().split():
        words = re.split("[-_]+", mark)
        if not LAYOUT.isdisjoint(words):
            continue
        if not in_article:
            if BOILERPLATE.search(mark):
                return True
        elif mark in INSERTED_WHOLE or INSERTED.fullmatch(words[0]) or INSERTED.fullmatch(words[-1]):
            return True
    return False


SHOWN, BY_NAME, HARD = 0, 1, 2


def described(name: str, attributes: str, in_article: bool = False) -> tuple[str, int, bool]:
    """Signature (name and first class or id), whether the element is boilerplate (by its class alone or surely), whether it names itself main."""
    hidden, main, mark, named = name in HIDDEN, name == "main", "", False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                mark = mark or re.sub(r"\d+", "", value.split(" ")[0]).lower()
                named |= name not in ("html", "body", "article", "main") and names_boilerplate(value, in_article)
                main |= name in ("div", "section", "td") and bool(MAIN.search(value))
            elif key == "role":
                hidden |= value.lower() in ROLES
                main |= value.lower() == "main"
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                hidden |= key != "hidden" or name not in ("html", "body")
    return f"{name}.{mark}" if mark else name, HARD if hidden else BY_NAME if named else SHOWN, main


class Walk:
    """Reads a page in order and calls `opened`, `closed` and `text` with the open block elements in `stack`."""

    def __init__(self):
        self.stack: list[tuple[str, str, int]] = []  # name, signature, inside boilerplate
        self.articles = 0  # open ones

    def run(self, page: str) -> None:
        for kind, value, attributes in tokens(page):
            if kind == "text":
                if value.strip():
                    self._imply_body()
                self.text(value)
            elif kind == "start":
                self._start(value, attributes)
            elif value in BLOCKS or value in HIDDEN:
                self._end(value)
                if value == "p":
                    self.broken()
        while self.stack:
            self._pop()

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text(" ")
            return
        if name not in BLOCKS and name not in HIDDEN:
            return
        if name not in IN_HEAD:
            self._imply_body(name)
        if name in BLOCKS and name not in ("html", "body"):
            self._imply(("p",))
        if name in ENDS:
            self._imply(ENDS[name])
        signature, hidden, main = described(name, attributes, self.articles > 0)
        if name in VOID:
            self.broken()
            return
        if name in ("html", "body") and any(n == name for n, _, _ in self.stack):
            return
        inside = max(hidden, self.stack[-1][2] if self.stack else SHOWN)
        if name == "main" and inside == BY_NAME:
            inside = SHOWN  # a class around the main element is that of a layout
        self.articles += name == "article"
        self.stack.append((name, signature, inside))
        self.opened(name, signature, inside, main)

    def _imply_body(self, name: str = "") -> None:
        """Where a head is not ended by its tag."""
        if self.stack and self.stack[-1][0] == "head":
            self._pop()

    def _imply(self, names: tuple[str, ...]) -> None:
        """Ends an open element of these names that no scope shields."""
        for k in range(len(self.stack) - 1, -1, -1):
            own = self.stack[k][0]
            if own in names:
                while len(self.stack) > k:
                    self._pop()
                if len(names) == 1:
                    return
            elif own in SCOPES:
                return

    def _end(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                while len(self.stack) > k:
                    self._pop()
                return

    def _pop(self) -> None:
        self.closed(*self.stack[-1])
        self.articles -= self.stack.pop()[0] == "article"

    def opened(self, name: str, signature: str, inside: int, main: bool) -> None: ...
    def closed(self, name: str, signature: str, inside: int) -> None: ...
    def text(self, value: str) -> None: ...
    def broken(self) -> None: ...


# A wrapper's node: [signature, repeated, optional, pages, characters of text in slots, literal text or None for a slot, children].
SIG, REPEATED, OPTIONAL, PAGES, CHARS, LITERAL, CHILDREN = range(7)


def _node(signature: str) -> list:
    return [signature, False, False, 1, 0, "", []]


def _literal(parts: list[str]) -> str:
    """The text of a block as wrappers compare it: the words, or if they are long, the first and a hash of all."""
    words = "".join(f" {p}" for p in parts)
    return words if len(words) <= 64 else f"{words[:48]}#{xxhash.xxh3_128_hexdigest(words.encode('utf-8', 'surrogatepass'))}"


class _Tree(Walk):
    def __init__(self):
        super().__init__()
        self.root = _node("page")
        self.open = [self.root]
        self.texts: list[list[str]] = [[]]

    def opened(self, name, signature, inside, main):
        own = _node(("!" if inside else "") + signature)
        self.open[-1][CHILDREN].append(own)
        self.open.append(own)
        self.texts.append([])

    def closed(self, name, signature, inside):
        self.finished()

    def finished(self):
        own = self.open.pop()
        own[LITERAL] = _literal(self.texts.pop())
        own[CHILDREN] = folded(own[CHILDREN])

    def text(self, value):
        own, words = self.open[-1], " ".join(value.split())
        if words:
            own[CHARS] += len(words)
            self.texts[-1].append(words)


def tree(page: str) -> list:
    built = _Tree()
    built.run(page)
    built.finished()
    return built.root


def _run(step: Generator):
    """Runs steps that yield the steps they need: pages nest deeper than Python recurses, so open steps are held in a list."""
    held, value = [step], None
    while held:
        try:
            held.append(held[-1].send(value))
            value = None
        except StopIteration as end:
            held.pop()
            value = end.value
    return value


def merged(a: list, b: list, pages: bool = True) -> list:
    """Two nodes of one signature as one: the alignment of their children, a slot where their texts differ."""
    return _run(_merged(a, b, pages))


def aligned(a: list[list], b: list[list], pages: bool = True) -> list[list]:
    return _run(_aligned(a, b, pages))


def folded(nodes: list[list]) -> list[list]:
    """Equal neighbours, alone or as sequences of two or three, as one repeated group."""
    return _run(_folded(nodes)) if len(nodes) > 1 else nodes


def _merged(a: list, b: list, pages: bool) -> Generator:
    children = (yield _aligned(a[CHILDREN], b[CHILDREN], pages)) if a[CHILDREN] or b[CHILDREN] else []
    return [
        a[SIG], a[REPEATED] or b[REPEATED], a[OPTIONAL] or b[OPTIONAL], a[PAGES] + b[PAGES] if pages else max(a[PAGES], b[PAGES]),
        a[CHARS] + b[CHARS], a[LITERAL] if a[LITERAL] == b[LITERAL] else None, children,
    ]


def _aligned(a: list[list], b: list[list], pages: bool) -> Generator:
    out = []
    for kind, i, j, k, m in SequenceMatcher(None, [x[SIG] for x in a], [x[SIG] for x in b], autojunk=False).get_opcodes():
        if kind == "equal":
            for x, y in zip(a[i:j], b[k:m]):
                out.append((yield _merged(x, y, pages)))
        else:
            out += [[*x[:OPTIONAL], True, *x[PAGES:]] for x in (*a[i:j], *b[k:m])]
    return (yield _folded(out)) if len(out) > 1 else out


def _folded(nodes: list[list]) -> Generator:
    out: list[list] = []
    for own in nodes:
        if out and out[-1][SIG] == own[SIG]:
            out[-1] = yield _merged(out[-1], own, False)
            out[-1][REPEATED] = True
        else:
            out.append(own)
        for size in (2, 3):
            if len(out) >= 2 * size and all(x[SIG] == y[SIG] for x, y in zip(out[-2 * size : -size], out[-size:])):
                both = []
                for x, y in zip(out[-2 * size : -size], out[-size:]):
                    both.append((yield _merged(x, y, False)))
                    both[-1][REPEATED] = True
                out[-2 * size :] = both
    return out


def _every(node: list) -> list[list]:
    """A node and all below it, in page order."""
    out, todo = [], [node]
    while todo:
        own = todo.pop()
        out.append(own)
        todo += reversed(own[CHILDREN])
    return out


def slot_chars(node: list) -> int:
    """Characters in a node's slots; boilerplate and texts that all pages share don't count."""
    return _slots(node)[id(node)]


def _slots(node: list) -> dict[int, int]:
    """`slot_chars` of a node and of all below it, by their identity."""
    out: dict[int, int] = {}
    for own in reversed(_every(node)):
        slots = own[CHARS] if own[LITERAL] is None or own[PAGES] < 2 else 0
        out[id(own)] = 0 if own[SIG].startswith("!") else slots + sum(out[id(x)] for x in own[CHILDREN])
    return out


def main_path(wrapper: list) -> dict:
    """Path of signatures to the deepest element that keeps most of the text, and whether articles repeat."""
    path, at, slots = [], wrapper, _slots(wrapper)
    while True:
        best = max(at[CHILDREN], key=lambda x: slots[id(x)], default=None)
        name = best[SIG].split(".")[0] if best else ""
        if best is None or name not in ("html", "body", "div", "section", "main", "article", "table", "tbody", "tr", "td", "center") or 10 * slots[id(best)] < 6 * slots[id(at)] or not slots[id(best)]:
            break
        path.append(best[SIG])
        at = best
    return {"path": path, "articles": any(x[REPEATED] and x[SIG].split(".")[0] == "article" for x in _every(wrapper))}


NO_WRAPPER = {"path": [], "articles": False}


class _Text(Walk):
    """Blocks of visible text under each candidate for the main element."""

    def __init__(self, path: list[str]):
        super().__init__()
        self.path = path
        self.regions: list[tuple[str, list[str]]] = []  # kind, blocks
        self.live: list[tuple[int, int]] = []  # depth, region
        self.buffer: list[str] = []

    def _imply_body(self, name=""):
        """Begins a body as well where its tag is left out; it has no signature, as wrappers don't have it."""
        super()._imply_body(name)
        if name not in ("html", "body") and (not self.stack or self.stack[-1][0] == "html"):
            self.stack.append(("body", "", SHOWN))
            self.opened("body", "", SHOWN, False)

    def broken(self):
        block = " ".join(html.unescape("".join(self.buffer)).split())
        self.buffer.clear()
        if block:
            for _, k in self.live:
                self.regions[k][1].append(block)

    def opened(self, name, signature, inside, main):
        self.broken()
        if inside:
            return
        kinds = ["body"] if name == "body" else []
        if name == "article" and not any(self.regions[k][0] == "article" for _, k in self.live):
            kinds.append("article")
        if main and not any(self.regions[k][0] == "main" for _, k in self.live):
            kinds.append("main")
        if self.path and len(self.stack) <= len(self.path) + 1 and [s for _, s, _ in self.stack if s] == self.path:
            kinds.append("wrapper")
        for kind in kinds:
            self.regions.append((kind, []))
            self.live.append((len(self.stack), len(self.regions) - 1))

    def closed(self, name, signature, inside):
        self.broken()
        self.live = [x for x in self.live if x[0] < len(self.stack)]

    def text(self, value):
        if self.stack and not self.stack[-1][2]:
            self.buffer.append(value)


def main_text(page: str | None, wrapper: dict | None = None) -> str:
    """The main text of a page: its blocks in order with two line breaks between.

    All articles outside boilerplate are kept; without any wrapper (a page alone) the longest one is.
    """
    walk = _Text(wrapper["path"] if wrapper else [])
    walk.run(page or "")
    for kind in ("article", "main", "wrapper", "body"):
        found = [blocks for k, blocks in walk.regions if k == kind and blocks]
        if found:
            if kind == "article" and wrapper is None:
                found = [max(found, key=lambda blocks: sum(map(len, blocks)))]
            return "\n\n".join(block for blocks in found for block in blocks)
    return ""


def _json(node: list) -> str:
    """A tree as a flat list: every node in page order with the number of its children in their place."""
    return json.dumps([[*x[:CHILDREN], len(x[CHILDREN])] for x in _every(node)], ensure_ascii=False, separators=(",", ":"))


def _read(shape: str) -> list:
    nodes = json.loads(shape)
    wanting: list[tuple[list, int]] = []  # open nodes and how many children they should have
    for own in nodes:
        count, own[CHILDREN] = own[CHILDREN], []
        while wanting and len(wanting[-1][0]) == wanting[-1][1]:
            wanting.pop()
        if wanting:
            wanting[-1][0].append(own)
        wanting.append((own[CHILDREN], count))
    return nodes[0]


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One aligned tree for each host of a task; hosts are let go in batches, so that a task holds few."""
    held: dict[str, list] = {}

    def flushed() -> pa.RecordBatch:
        rows = [pa.array(held, pa.string()), pa.array(map(_json, held.values()), pa.string())]
        held.clear()
        return pa.RecordBatch.from_arrays(rows, ["host", "shape"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = tree(page or "")
            held[host] = merged(held[host], own) if host in held else own
        if len(held) > 2000:
            yield flushed()
    if held:
        yield flushed()


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of runs of (part, host): rows come sorted, one wrapper is held at a time."""
    part = host = wrapper = None
    out: list[tuple] = []
    for batch in batches:
        for p, h, shape in zip(*(c.to_pylist() for c in batch.columns)):
            own = _read(shape)
            if (p, h) != (part, host):
                if wrapper is not None:
                    out.append((host, _json(wrapper)))
                part, host, wrapper = p, h, own
            else:
                wrapper = merged(wrapper, own)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], ["host", "shape"])
            out = []
    if wrapper is not None:
        yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([_json(wrapper)])], ["host", "shape"])


def inferred(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """`host`, `wrapper` (JSON of the tree) for every host of `pages`."""
    schema = "host string, shape string"
    rows = pages.select(host_of(F.col(url).cast("string")).alias("host"), F.col(page).cast("string").alias("html"))
    shapes = rows.mapInArrow(_shapes, schema).withColumn("part", F.pmod(F.xxhash64("shape"), F.lit(FANIN)))
    parts = shapes.select("part", "host", "shape").repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(_reduced, schema)
    whole = parts.select(F.lit(0).alias("part"), "host", "shape").repartition("host").sortWithinPartitions("host").mapInArrow(_reduced, schema)
    return whole.withColumnRenamed("shape", "wrapper")


def _path_of(wrappers: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(main_path(_read(w))) for w in wrappers], dtype=object)


def extracted(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """The rows of `pages` with the main text of each page, by the wrapper of its host."""
    wrappers = inferred(pages, url, page).select(F.col("host").alias("_host"), F.pandas_udf(_path_of, "string")("wrapper").alias("_wrapper"))
    wrappers = parked(wrappers, "wrappers")

    def run(html_: pd.Series, wrapper: pd.Series) -> pd.Series:
        read: dict[str, dict] = {}
        texts = []
        for p, w in zip(html_, wrapper):
            if w is not None and w not in read:
                read[w] = json.loads(w)
            texts.append(main_text(p, read.get(w, NO_WRAPPER)))
        return pd.Series(texts, dtype=object)

    rows = pages.select(F.struct(*pages.columns).alias("_row"), host_of(F.col(url).cast("string")).alias("_of"))
    both = rows.join(wrappers, F.col("_of") == F.col("_host"), "left")
    text = F.pandas_udf(run, "string")(F.col("_row")[page].cast("string"), "_wrapper")
    return both.select(*[F.col("_row")[c].alias(c) for c in pages.columns if c != out], text.alias(out))
