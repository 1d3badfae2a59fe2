"""Text helpers: normalisation, mention matching and article extraction inside Arrow batches."""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

# Functions of this module travel to the executors by value, so they need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Short names that are everyday words in financial prose.
AMBIGUOUS_NAMES = (
    "大量", "統一", "聯合", "精確", "全新", "材料", "世界", "中華", "安心", "新建", "光明", "東方",
    "正道", "中環", "三洋", "中化", "大成", "遠見", "力行", "巨大", "全國", "無敵", "至上",
)
# Fixed patterns: words that set a finance context, words that follow a company name, marks that precede one.
CONTEXT_WORDS = r"股票|股價|台股|持股|營收|買超|賣超|法人|ETF|標的"
FOLLOWING_WORDS = r"\s*(?:股價|營收|法說會|漲停|跌停|目標價|本益比|董事長|總經理|除息)"
# The subject mark is this word in brackets or before a colon.
SUBJECT = "標的"
CODE_LEFT = r"(?<![\dA-Za-z/.$])"
CODE_RIGHT = r"(?![\dA-Za-z/]|\.\d|\s*(?:元|塊|圓|美元|%|張|年|月|日))"


def fold(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").replace("臺", "台")


def folded(column):
    """NFKC with one spelling of the place name."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fold, na_action="ignore")

    return run(column)


def search_normal(column):
    """Search form of a code or name, including full-width folding."""
    return F.trim(F.lower(folded(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))))


_CONTEXT, _FOLLOWING = re.compile(CONTEXT_WORDS, re.I), re.compile(FOLLOWING_WORDS)
_CODE_LEFT, _CODE_RIGHT = re.compile(CODE_LEFT), re.compile(CODE_RIGHT)


class MentionMatcher:
    """Which securities one text names, of those whose name or code it holds: (symbol, name, ambiguous) entries.

    ``places`` gives all starts of the words in the folded text where they are known; the text is searched otherwise.
    """

    def __init__(self, entries, places: dict[str, list[int]] | None = None):
        self.places = places
        self.symbols_of: dict[str, list[str]] = {}
        self.ambiguous: set[str] = set()
        self.codes, self.long_names = set(), set()
        for symbol, name, ambiguous in entries:
            self.codes.add(symbol)
            if name and len(name) > 2:
                # Long names set a finance context in their own spelling, which may differ from the folded one.
                self.long_names.add(name.replace("臺", "台"))
            if fold(name):
                self.symbols_of.setdefault(fold(name), []).append(symbol)
                if ambiguous:
                    self.ambiguous.add(fold(name))

    def starts(self, word: str, text: str) -> Iterator[int]:
        """Where a word begins, overlaps included."""
        if self.places is not None:
            yield from self.places.get(word, ())
            return
        at = text.find(word)
        while at >= 0:
            yield at
            at = text.find(word, at + 1)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Name occurrences that lie in no longer occurrence."""
        found = []
        for name in self.symbols_of:
            end = 0
            for at in self.starts(name, text):
                if at >= end:
                    end = at + len(name)
                    found.append((at, end, name))
        # Longest first at each start: a span lies inside another exactly when an earlier one reaches its end.
        found.sort(key=lambda s: (s[0], -s[1]))
        kept, reach = [], -1
        for span in found:
            if span[1] > reach:
                kept.append(span)
                reach = span[1]
        return kept

    @staticmethod
    def is_marked(text: str, start: int) -> bool:
        """The text before a name ends with the subject mark; looks back over white space only, never at the whole head."""

        def back(i: int) -> int:
            while i and text[i - 1].isspace():
                i -= 1
            return i

        i = back(start)
        if text.endswith((":", "："), 0, i):
            i = back(i - 1)
            return text.endswith(SUBJECT, 0, i)
        return text.endswith(f"[{SUBJECT}]", 0, i)

    def is_code(self, symbol: str, text: str) -> bool:
        """The symbol stands alone somewhere: no number, unit, price or date around it."""
        return any(_CODE_LEFT.match(text, at) and _CODE_RIGHT.match(text, at + len(symbol)) for at in self.starts(symbol, text))

    def identify(self, raw: str | None) -> list[str]:
        text = fold(raw)
        context = bool(_CONTEXT.search(text)) or any(n in text for n in self.long_names)
        hits: set[str] = set()
        for start, end, name in self.spans(text):
            if name in self.ambiguous:
                named = _FOLLOWING.match(text, end) or self.is_marked(text, start)
            else:
                named = len(name) > 2 or context
            if named:
                hits.update(self.symbols_of[name])
        if context:
            hits.update(s for s in self.codes if s and s not in hits and self.is_code(s, text))
        return sorted(hits)


_MARKUP = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][\w-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_CLASS_OR_ID = re.compile(r"\b(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Classes and elements of a board page that are no article text, and the class of its header values.
META_CLASS = "article-meta-value"
NO_TEXT_CLASSES = frozenset(("push", META_CLASS, "article-metaline", "article-metaline-right"))
NO_TEXT_TAGS = frozenset(("script", "style"))


class Region:
    """An element of a page by counting: from its start tag until as many of its name have ended as began."""

    def __init__(self):
        self.name, self.depth = "", 0

    def started(self, name: str, begins: bool) -> None:
        if self.depth:
            self.depth += name == self.name
        elif begins:
            self.name, self.depth = name, 1

    def ended(self, name: str) -> bool:
        """Whether this end tag closes the region."""
        if self.depth and name == self.name:
            self.depth -= 1
            return not self.depth
        return False


def article_parts(page: str | None, main_id: str = "main-content") -> tuple[list[str], str]:
    """Header values and the visible text of a board page's main element; a region inside a region needs no stack."""
    main, dark, header = Region(), Region(), Region()
    values, text, value = [], [], []
    page, at = page or "", 0
    while at < len(page):
        m = _MARKUP.match(page, at)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if header.depth:
                value.append(m[4] or "")
            if main.depth and not dark.depth:
                text.append(m[4] or "")
        elif m[1]:
            if header.ended(name):
                values.append(html.unescape("".join(value)).strip())
                value = []
            dark.ended(name)
            main.ended(name)
        elif name in NO_TEXT_TAGS:  # no tags inside: go on behind its end
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            found = {k.lower(): a or b or c for k, a, b, c in _CLASS_OR_ID.findall(m[3])}
            classes = set(found.get("class", "").split())
            header.started(name, name == "span" and META_CLASS in classes)
            dark.started(name, bool(classes & NO_TEXT_CLASSES))
            main.started(name, found.get("id") == main_id)
    return values, html.unescape("".join(text))
