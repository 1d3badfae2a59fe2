"""License scans: template markup compiled into token automata.

A template is plain wording with two kinds of marked regions, after the public SPDX template markup:
``<<beginOptional>> ... <<endOptional>>`` may be left out as a whole (regions may nest), and ``<<var;words=lo-hi>>``
stands for lo to hi words of any wording (a name, a year). All other words are mandatory and must match exactly, one after
the other. Matching is on words, so case (A-Z), punctuation and line breaks don't count.

Null and empty texts have no words and no labels; a long text is scanned whole, every place is counted; repeated rows are
scanned each; other columns pass through.
"""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import plain_words

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# License wording, with label first.
TEMPLATES = {
    "apache-2.0": "Licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License <<beginOptional>>Version<<endOptional>> 2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;words=0-4>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<var;words=0-4>> Redistributions in binary form must reproduce the above copyright notice",
    "cc-by-4.0": "licensed under <<beginOptional>>a Creative Commons<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY 4.0",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>a Creative Commons<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC 4.0",
    "cc-by-sa-4.0": "licensed under <<beginOptional>>a Creative Commons<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-SA 4.0",
    "gpl-2.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> version 2",
    "gpl-3.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mit-notice": "released under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;words=1-6>> and associated documentation files <<beginOptional>>(the \"Software\")<<endOptional>> to deal in <<var;words=1-4>> without restriction",
    "mpl-2.0": "subject to the terms of the Mozilla Public License <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2.0",
}
_MARK = re.compile(r"<<\s*(beginOptional|endOptional|var)[^>]*?(?:words=(\d+)-(\d+))?\s*>>")


def parse(markup: str) -> list:
    """A template as nested items: a word, ("gap", lo, hi) or ("optional", items)."""
    stack, at = [[]], 0
    for m in _MARK.finditer(markup):
        stack[-1] += plain_words(markup[at : m.start()])
        at = m.end()
        if m[1] == "var":
            stack[-1].append(("gap", int(m[2] or 0), int(m[3] or 20)))
        elif m[1] == "beginOptional":
            stack.append([])
        else:
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0] + plain_words(markup[at:])


class Automaton:
    """The token automaton of one template; sets of states are made deterministic as texts need them."""

    def __init__(self, markup: str):
        items = parse(markup)
        if not items or not isinstance(items[0], bytes):
            raise ValueError("a template begins with a mandatory word")
        self.on_word: list[dict[bytes, int]] = [{}]
        self.on_any: list[list[int]] = [[]]
        self.empty: list[list[int]] = [[]]
        self.final = self._add(items, 0)
        self.known = {w for d in self.on_word for w in d}
        self.first = items[0]
        self.begin = self._closed({0})
        self.steps: dict[tuple[frozenset, bytes | None], frozenset] = {}

    def _state(self) -> int:
        self.on_word.append({})
        self.on_any.append([])
        self.empty.append([])
        return len(self.on_word) - 1

    def _add(self, items: list, at: int) -> int:
        for item in items:
            if isinstance(item, bytes):
                to = self._state()
                self.on_word[at][item] = to
                at = to
            elif item[0] == "optional":
                own = self._state()  # its own entry, so that the region and what follows may begin with the same word
                self.empty[at].append(own)
                end, out = self._add(item[1], own), self._state()
                self.empty[end].append(out)
                self.empty[at].append(out)
                at = out
            else:
                _, lo, hi = item
                out = self._state()
                for k in range(hi + 1):
                    if k >= lo:
                        self.empty[at].append(out)
                    if k < hi:
                        to = self._state()
                        self.on_any[at].append(to)
                        at = to
                at = out
        return at

    def _closed(self, states: set[int]) -> frozenset:
        todo = list(states)
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return frozenset(states)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word if word in self.known else None)
        if key not in self.steps:
            to = {self.on_word[s][word] for s in states if word in self.on_word[s]}
            self.steps[key] = self._closed(to.union(*(self.on_any[s] for s in states)))
        return self.steps[key]

    def end(self, words: list[bytes], start: int) -> int | None:
        """End of the shortest match that begins at `start`, or None."""
        states = self.begin
        for at in range(start, len(words)):
            states = self.step(states, words[at])
            if not states:
                return None
            if self.final in states:
                return at + 1
        return None


@cache
def automata() -> dict[str, Automaton]:
    return {label: Automaton(markup) for label, markup in TEMPLATES.items()}


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, template labels, template places of one text."""
    words = plain_words(text)
    line = b" " + b" ".join(words) + b" "
    starts: list[int] = []
    base, found, places = set(), set(), 0
    for phrase, label in PHRASES.items():
        mark, at, word, counted = b" " + phrase.encode() + b" ", -1, 0, 0
        while (at := line.find(mark, at + 1)) >= 0:
            word, counted = word + line.count(b" ", counted, at), at
            starts.append(word)
            base.add(label)
    present: dict[bytes, list[int]] = {}
    for label, automaton in automata().items():
        first = automaton.first
        if first not in present:
            present[first] = [i for i, w in enumerate(words) if w == first] if b" " + first + b" " in line else []
        hits = sum(automaton.end(words, i) is not None for i in present[first])
        places += hits
        if hits:
            found.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), places


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, n_templates long"


def _scanned(texts: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([scan(t) for t in texts], columns=[c.split()[0] for c in SCHEMA.split(", ")])
    return out.astype({"first_word": "Int64", "last_word": "Int64"})


def scans(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `df` with a struct `license`; `score` is 1 for a template's wording, 0.5 for a phrase alone, else 0."""
    held = df.withColumn("license", F.pandas_udf(_scanned, SCHEMA)(F.col(text).cast("string")))
    got = F.col("license")
    score = F.when(got["n_templates"] > 0, F.lit(1.0)).when(got["n_base"] > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return held.withColumn("license", got.withField("score", score))
