"""License scans by template markup compiled to token automata (operator 2).

A template is a license notice with ``<<opt>> ... <<end>>`` around wording that
may be missing and ``<<any N>>`` for up to N words that may be anything (names,
years, version numbers). All other words must stand exactly as written. Each
template becomes an automaton over words; from every place where it can begin,
all its open states advance together, and the set of states reached by a word
is remembered, so an automaton is in fact run as a deterministic one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from entityloom.llm.workers import kept

#: Fixed by the query's contract: phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files the software to deal in the software without "
    "restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom "
    "the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice "
)
AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but "
    "not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement in no event shall "
)
CLAIMS = (
    "be liable for any claim damages or other liability whether in an action of contract tort or "
    "otherwise arising from out of or in connection with the software or the use or other dealings "
    "in the software"
)

#: Public notices; a label may have several. The texts have the whole wording of the notice.
TEMPLATES: list[tuple[str, str]] = [
    (
        "mit-text",
        MIT_GRANT + "<<opt>> including the next paragraph <<end>> shall be included in all copies or "
        "substantial portions of the software " + AS_IS + "<<any 8>> " + CLAIMS,
    ),
    (
        "mit-text",
        MIT_GRANT + "shall be included in all copies or substantial portions of the software "
        + AS_IS + "the authors or copyright holders " + CLAIMS,
    ),
    ("mit-notice", "<<opt>> released <<end>> <<opt>> licensed <<end>> <<opt>> distributed <<end>> "
     "<<opt>> available <<end>> under the <<opt>> terms of the <<end>> mit license"),
    (
        "isc-text",
        "permission to use copy modify and <<opt>> or <<end>> distribute this software for any "
        "purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies the software is provided as is and <<any 8>> "
        "disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall <<any 8>> be liable for any special direct "
        "indirect or consequential damages or any damages whatsoever resulting from loss of use data "
        "or profits whether in an action of contract negligence or other tortious action arising out "
        "of or in connection with the use or performance of this software",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met <<any 2>> redistributions of "
        "source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer <<any 2>> redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution "
        "<<opt>> <<any 2>> all advertising materials mentioning features or use of this software must "
        "display the following acknowledgement this product includes software developed by <<any 12>> "
        "<<end>> <<opt>> <<any 2>> neither the name of <<any 8>> nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific prior written "
        "permission <<end>> this software is provided by <<any 8>> as is and any express or implied "
        "warranties including but not limited to the implied warranties of merchantability and fitness "
        "for a particular purpose are disclaimed in no event shall <<any 8>> be liable for any direct "
        "indirect incidental special exemplary or consequential damages including but not limited to "
        "procurement of substitute goods or services loss of use data or profits or business "
        "interruption however caused and on any theory of liability whether in contract strict "
        "liability or tort including negligence or otherwise arising in any way out of the use of this "
        "software even if advised of the possibility of such damage",
    ),
    ("bsd-notice", "licensed under the <<opt>> <<any 3>> <<end>> bsd <<opt>> <<any 2>> <<end>> license"),
    (
        "apache-2-notice",
        "licensed under the <<opt>> terms of the <<end>> apache license <<opt>> version <<end>> 2 "
        "<<opt>> 0 <<end>>",
    ),
    (
        "apache-2-header",
        "licensed under the apache license version 2 0 the license you may not use this file except "
        "in compliance with the license you may obtain a copy of the license at",
    ),
    (
        "gpl-notice",
        "licensed under <<opt>> the terms of <<end>> the gnu general public license "
        "<<opt>> <<any 3>> version 2 <<end>> <<opt>> <<any 3>> version 3 <<end>>",
    ),
    (
        "gpl-header",
        "redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version <<any 2>> of the license or "
        "<<opt>> at your option <<end>> any later version",
    ),
    (
        "lgpl-notice",
        "under the <<opt>> terms of the <<end>> gnu <<opt>> lesser <<end>> <<opt>> library <<end>> "
        "general public license lgpl",
    ),
    ("lgpl-notice", "licensed under <<opt>> the terms of <<end>> the gnu lesser general public license"),
    ("agpl-notice", "licensed under <<opt>> the terms of <<end>> the gnu affero general public license"),
    (
        "mpl-2-notice",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
    ("mpl-2-notice", "licensed under the mozilla public license <<opt>> version <<end>> 2 0"),
    (
        "cc-notice",
        "licensed under <<opt>> a <<end>> <<opt>> the <<end>> creative commons attribution "
        "<<opt>> <<any 4>> <<end>> <<opt>> international <<end>> license",
    ),
    ("cc-by-nc-notice", "licensed under <<opt>> the <<end>> cc by nc <<opt>> sa <<end>> <<opt>> nd <<end>> "
     "<<opt>> 4 0 <<end>>"),
    ("cc-by-notice", "licensed under <<opt>> the <<end>> cc by <<opt>> sa <<end>> <<opt>> 4 0 <<end>> license"),
    (
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to "
        "copy modify publish use compile sell or distribute this software either in source code form "
        "or as a compiled binary for any purpose commercial or non commercial and by any means in "
        "jurisdictions that recognize copyright laws the author or authors of this software dedicate "
        "any and all copyright interest in the software to the public domain we make this dedication "
        "for the benefit of the public at large and to the detriment of our heirs and successors we "
        "intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
        "future rights to this software under copyright law " + AS_IS + "the authors " + CLAIMS,
    ),
]

#: For each byte of UTF-8: A to Z become small letters, what is in no word a space; bytes from 128 on are of letters.
FOLDED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


@dataclass
class Automaton:
    """States are numbers; ``moves`` lead on by a word, ``skips`` without one."""

    label: str
    markup: str
    moves: list[tuple[str | None, int]] = field(default_factory=list)  # None takes any word
    skips: dict[int, list[int]] = field(default_factory=dict)
    mandatory: list[bool] = field(default_factory=list)

    def __post_init__(self) -> None:
        parts = re.findall(r"<<opt>>|<<end>>|<<any \d+>>|\S+", self.markup)
        opened: list[int] = []
        for part in parts:
            at = len(self.moves)
            if part == "<<opt>>":
                opened.append(at)
            elif part == "<<end>>":
                self.skips.setdefault(opened.pop(), []).append(at)
            elif part.startswith("<<any"):
                n = int(part[6:-2])
                self.moves += [(None, at + i + 1) for i in range(n)]
                for i in range(n):
                    self.skips.setdefault(at + i, []).append(at + n)
                self.mandatory += [False] * n
            else:
                self.moves.append((part, at + 1))
                self.mandatory.append(not opened)
        self.final = len(self.moves)
        self.needed = max(1, sum(self.mandatory))
        self.start = self._closed({0})
        self.memory: dict[tuple[frozenset, str], frozenset] = {}
        written = [w for w, _ in self.moves if w is not None]
        self.words = {w: w for w in written} | {w.encode(): w for w in written}

    def _closed(self, states: set[int]) -> frozenset:
        left, seen = list(states), set(states)
        while left:
            for s in self.skips.get(left.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    left.append(s)
        return frozenset(seen)

    def first_words(self) -> set[str]:
        return {self.moves[s][0] for s in self.start if s < self.final and self.moves[s][0]}

    def step(self, states: frozenset, word: str | bytes) -> frozenset:
        word = self.words.get(word, "")
        key = (states, word)
        if key not in self.memory:
            on = {self.moves[s][1] for s in states if s < self.final and self.moves[s][0] in (None, word)}
            self.memory[key] = self._closed(on)
        return self.memory[key]

    def run(self, words: list[str] | list[bytes], at: int) -> tuple[int, float]:
        """End of the longest accepted run from ``at`` (else -1); share of mandatory words read.

        Words come as text or as UTF-8.
        """
        states, end, best = self.start, -1, 0
        for i in range(at, len(words)):
            states = self.step(states, words[i])
            if not states:
                break
            best = max(best, max(states))
            if self.final in states:
                end = i + 1
        return end, sum(self.mandatory[:best]) / self.needed


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], base: dict[str, str]):
        self.base = [(p.encode().split(), label) for p, label in base.items()]
        self.by_word: dict[str, list[Automaton]] = {}
        for label, markup in templates:
            automaton = Automaton(label, markup)
            for word in automaton.first_words():
                self.by_word.setdefault(word, []).append(automaton)
        self.firsts = {p[0] for p, _ in self.base} | {w.encode() for w in self.by_word}

    def scan(self, text: str | bytes) -> tuple:
        """Words stay UTF-8: a text is folded and cut as bytes, whatever its letters."""
        words = (text.encode() if isinstance(text, str) else text).translate(FOLDED).split()
        n = len(words)
        starts, base, found, spans, score = [], set(), set(), [], 0.0
        for at in [i for i, w in enumerate(words) if w in self.firsts]:
            word = words[at]
            for phrase, label in self.base:
                if word == phrase[0] and words[at : at + len(phrase)] == phrase:
                    starts.append(at)
                    base.add(label)
            for automaton in self.by_word.get(word.decode(), ()):
                end, share = automaton.run(words, at)
                score = max(score, share if end < 0 else 1.0)
                if end > 0:
                    found.add(automaton.label)
                    spans.append((automaton.label, at, end))
        if base:
            score = 1.0
        first, last = (min(starts), max(starts)) if starts else (None, None)
        join = lambda labels: ",".join(sorted(labels))
        return n, len(starts), first, last, join(base), join(base | found), score, spans


SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
COLUMNS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(SPAN),
}
SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, spans array<struct<label:string,start:long,end:long>>"
)


def scan_licenses(
    text: Column,
    templates: list[tuple[str, str]] | None = None,
    base: dict[str, str] | None = None,
) -> Column:
    """Struct of word and phrase counts, labels, and the spans that templates accepted.

    A null or empty text has no words and no labels. The score is 1 where a
    phrase or template was found, else the largest share of a template's
    mandatory words that was read from where it can begin.
    """
    own = TEMPLATES if templates is None else templates
    phrases = BASE if base is None else base

    @F.arrow_udf(SCHEMA)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = kept(("licenses", str(own), str(phrases)), lambda: Scanner(own, phrases))
        for texts in batches:
            *plain, spans = zip(*map(scanner.scan, texts.to_pylist()), strict=True) if len(texts) else [()] * len(COLUMNS)
            named = [[dict(zip(("label", "start", "end"), x, strict=True)) for x in found] for found in spans]
            columns = [pa.array(x, kind) for x, kind in zip([*plain, named], COLUMNS.values(), strict=True)]
            yield pa.StructArray.from_arrays(columns, names=list(COLUMNS))

    return scanned(F.coalesce(text, F.lit("")).cast("binary"))
