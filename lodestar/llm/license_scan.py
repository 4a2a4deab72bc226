"""License scans: licence templates with optional and replaceable regions, matched as token automata.

Markup of a template: plain words are mandatory; ``<<beginOptional>> ... <<endOptional>>`` (which nests) may be left out as a
whole; ``<<var;words=LOW..HIGH;match=REGEX>>`` stands for LOW to HIGH words of which each matches REGEX (any word without it).
A template compiles into a token automaton whose mandatory wording has to be met word for word; sets of its states are
made deterministic while texts are read. Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased. A match is the longest one from its start, and the next one of that template starts after its end.

Null and empty texts have no word and no match. Repeated rows are scanned one by one. Columns besides the id and the text
are not looked at, whatever their names. A row with a null id keeps that null id. Very long texts are scanned whole. Of matches of a
template that begin at one word the longest counts, so none tie; templates don't hinder each other. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, texts, utf8

#: Byte table: ASCII letters in lower case, digits and non-ASCII bytes stay, all others become a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_GRANT = "<<beginOptional>>this <<var;words=1..1;match=work|software|file|program|text|document>> is<<endOptional>> <<var;words=1..1;match=licensed|released|distributed|available|published>> under <<beginOptional>>the terms of<<endOptional>>"

#: Labels and their templates. A label may have several.
TEMPLATES = [
    ("apache-2.0", f"{_GRANT} the apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license <<beginOptional>>you may obtain a copy of the license at <<var;words=0..8;match=[a-z0-9]+>><<endOptional>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<var;words=0..1;match=1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<var;words=0..1;match=2>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>><<var;words=0..1;match=3>> neither the name of <<var;words=1..12;match=[^ ]+>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<<endOptional>>"),
    ("cc-by-family", f"{_GRANT} <<beginOptional>>a creative commons attribution<<endOptional>> cc by <<var;words=0..2;match=nc|nd|sa>> <<var;words=1..1;match=[1-4]>> <<var;words=1..1;match=[05]>> <<beginOptional>>international<<endOptional>>"),
    ("gpl-notice", f"{_GRANT} the gnu <<beginOptional>>lesser<<endOptional>> general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version <<var;words=1..1;match=[1-3]>> <<beginOptional>>or at your option any later version<<endOptional>>"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu <<beginOptional>><<var;words=1..1;match=lesser|affero>><<endOptional>> general public license as published by the free software foundation either version <<var;words=1..1;match=[1-3]>> of the license or at your option any later version"),
    ("isc", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", f"{_GRANT} the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 <<beginOptional>>if a copy of the mpl was not distributed with this file you can obtain one at <<var;words=0..6;match=[a-z0-9]+>><<endOptional>>"),
    ("proprietary", "<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> <<var;words=1..1;match=[0-9]{4}>> <<var;words=0..6;match=[a-z]+>><<endOptional>> all rights reserved"),
]


def _parse(markup: str) -> list:
    """Template markup to a list of ("word", w), ("var", low, high, regex) and ("opt", list)."""
    stack: list[list] = [[]]
    for piece in re.split(r"(<<.*?>>)", markup):
        if not piece.startswith("<<"):
            stack[-1] += [("word", w) for w in piece.encode().translate(WORD_BYTES).split()]
        elif piece == "<<beginOptional>>":
            stack.append([])
        elif piece == "<<endOptional>>":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        elif m := re.fullmatch(r"<<var;words=(\d+)\.\.(\d+)(?:;match=(.*))?>>", piece):
            if int(m[1]) > int(m[2]):
                raise ValueError(f"an empty range of words: {piece}")
            stack[-1].append(("var", int(m[1]), int(m[2]), m[3] or ".+"))
        else:
            raise ValueError(f"unknown markup {piece}")
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


@dataclass
class TokenAutomaton:
    """An automaton over words, made deterministic as far as texts need it."""

    label: str
    markup: str
    arcs: list[list[tuple]] = field(default_factory=list)  # per state: (test, next); test: a word or a regex
    final: int = -1
    anchor: bytes = b""  # the longest run of plain mandatory words, with spaces; empty if there is none: then any text may match

    def __post_init__(self) -> None:
        skips: list[tuple[int, int]] = []
        self.arcs = [[]]
        tree = _parse(self.markup)

        def add(nodes: list, at: int) -> int:
            for kind, *x in nodes:
                if kind == "opt":
                    end = add(x[0], at)
                    skips.append((at, end))
                    at = end
                    continue
                low, high, test = (1, 1, x[0]) if kind == "word" else (x[0], x[1], re.compile(x[2].encode()))
                chain = [at]
                for _ in range(high):
                    self.arcs.append([])
                    self.arcs[chain[-1]].append((test, len(self.arcs) - 1))
                    chain.append(len(self.arcs) - 1)
                at = chain[-1]
                skips.extend((state, at) for state in chain[low:high])
            return at

        self.final = add(tree, 0)
        self._skips: dict[int, set[int]] = {}
        for a, b in skips:
            self._skips.setdefault(a, set()).add(b)
        self._start = self._close({0})
        if self.final in self._start:
            raise ValueError("a template needs mandatory words")
        self._moves: dict[tuple[frozenset, bytes], frozenset] = {}
        runs, run = [], []
        for kind, *x in [*tree, ("var",)]:
            if kind == "word":
                run.append(x[0])
            else:
                runs.append(run)
                run = []
        longest = max(runs, key=lambda r: sum(map(len, r)))
        self.anchor = b" " + b" ".join(longest) + b" " if longest else b""

    def _close(self, states: set[int]) -> frozenset:
        todo, seen = [*states], set(states)
        while todo:
            for b in self._skips.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)

    def move(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word)
        if key not in self._moves:
            if len(self._moves) > 50_000:  # a cache: what is dropped is worked out again
                self._moves.clear()
            self._moves[key] = self._close({b for a in states for test, b in self.arcs[a] if (test == word if isinstance(test, bytes) else test.fullmatch(word))})
        return self._moves[key]

    def matches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(first word, end) of each match."""
        found, i = [], 0
        while i < len(words):
            states, j, end = self._start, i, 0
            while j < len(words) and states:
                states = self.move(states, words[j])
                j += 1
                if self.final in states:
                    end = j
            if end:
                found.append((i, end))
            i = end or i + 1
        return found

    def regex(self) -> str:
        """The same template as a regular expression over words with one space after each; for checks by another engine."""

        def of(nodes: list) -> str:
            out = ""
            for kind, *x in nodes:
                if kind == "word":
                    out += x[0].decode() + " "
                elif kind == "opt":
                    out += f"(?:{of(x[0])})?"
                else:
                    out += f"(?:(?:{x[2]}) ){{{x[0]},{x[1]}}}"
            return out

        return of(_parse(self.markup))


def _places(norm: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which phrase (with a space on both sides) stands in norm."""
    out, at, word, last = [], norm.find(phrase), 0, 0
    while at >= 0:
        word += norm.count(b" ", last, at)
        last = at
        out.append(word)
        at = norm.find(phrase, at + 1)
    return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, base_places array<struct<label, start>>, matches array<struct<label, start, end>> (word numbers; end exclusive)."""
    templates, phrases = TEMPLATES if templates is None else templates, BASE_PHRASES if phrases is None else phrases
    base = [(b" " + b" ".join(p.encode().translate(WORD_BYTES).split()) + b" ", label) for p, label in phrases.items()]
    kinds = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    made: list[TokenAutomaton] = []

    def one(batch: pa.RecordBatch) -> dict:
        if not made:
            made.extend(TokenAutomaton(*t) for t in templates)
        counts, places, spans = [], [], []
        for data in utf8(batch.column(1)):
            words = data.translate(WORD_BYTES).split()
            norm = b" " + b" ".join(words) + b" "
            counts.append(len(words))
            places.append([{"label": label, "start": at} for phrase, label in base if phrase in norm for at in _places(norm, phrase)])
            spans.append([{"label": a.label, "start": i, "end": j} for a in made if a.anchor in norm for i, j in a.matches(words)])
        return {"doc_id": batch.column(0), "n_words": pa.array(counts, pa.int64()), "base_places": pa.array(places, kinds[0]), "matches": pa.array(spans, kinds[1])}

    return map_rows(texts(docs, id_col, text_col), one, "doc_id long, n_words long, base_places array<struct<label:string,start:long>>, matches array<struct<label:string,start:long,end:long>>")
