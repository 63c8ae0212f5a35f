"""Licence scanning: templates with optional and replaceable regions as automata over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, set_aside, small_batches, utf8

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words that a replaceable region never takes in: with them its wording would grant, forbid or demand something.
CONDITIONS = frozenset(
    "only not no nor never non must shall may can cannot could will would should except excluding unless if when where until while provided providing condition conditions subject permission permissions permit permits permitted prohibited prohibits forbidden allowed disallowed restricted restriction restrictions required requires commercial commercially noncommercial sell sells sold sale selling resale pay pays paid payment fee fees royalty royalties charge charges rent use uses used using distribute distributes distributed distribution redistribute modify modifies modified modification granted grant grants revoked terminate terminates written consent warranty warranties liable liability damages obligation however but option options version later nothing else anything".split()
)

# The wording of public licences, as templates. [[ ]] encloses an optional region; {{m-n}} is a replaceable
# region of m to n words, {{m-}} of m words or more, of which none is in CONDITIONS. Everything else is mandatory, word by word.
_AS_IS_HOLDERS = """this software is provided by {{1-}} as is and any express or implied warranties including but not limited to the implied
 warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{1-}} be liable for any direct indirect
 incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or
 profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or
 otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_BSD_2 = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
 [[1]] [[a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
 [[2]] [[b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
 in the documentation and or other materials provided with the distribution"""
_MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of {{1-}} to deal in the software without restriction including
 without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom
 the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
 [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without
 warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
 noninfringement in no event shall {{1-}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising
 from out of or in connection with the software or the use or other dealings in the software"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
 copyright notice and this permission notice appear in all copies the software is provided as is and {{1-}} disclaims all warranties with regard to this
 software including all implied warranties of merchantability and fitness in no event shall {{1-}} be liable for any special direct indirect or
 consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
 action arising out of or in connection with the use or performance of this software"""
_APACHE_HEADER = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a
 copy of the license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software
 distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for
 the specific language governing permissions and limitations under the license"""


def _gnu(name: str, version: str) -> str:
    """The notice that files under a licence of that family carry."""
    return f"""is free software you can redistribute it and or modify it under the terms of the gnu {name} public license as published by the free software
 foundation [[either]] version {version} of the license [[or at your option any later version]] {{{{1-}}}} is distributed in the hope that it will be useful
 but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} public license for
 more details"""


TEMPLATES = {
    "mit-notice": ["[[this {{0-}} is]] [[released]] [[licensed]] under the [[terms of the]] mit license"],
    "mit-text": [_MIT_GRANT],
    "bsd-2-clause-text": [f"{_BSD_2} {_AS_IS_HOLDERS}"],
    "bsd-3-clause-text": [f"{_BSD_2} [[3]] [[c]] neither the name of {{{{1-}}}} nor the names of {{{{1-}}}} contributors may be used to endorse or promote products derived from this software without specific prior written permission {_AS_IS_HOLDERS}"],
    "isc-text": [_ISC],
    "apache-2.0-notice": ["licensed under the apache license version 2 0 [[the license]]"],
    "apache-2.0-header": [_APACHE_HEADER],
    "gpl-2.0-notice": ["licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2"],
    "gpl-3.0-notice": ["licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3"],
    "gpl-2.0-header": [_gnu("general", "2")],
    "gpl-3.0-header": [_gnu("general", "3")],
    "lgpl-2.1-header": [_gnu("lesser general", "2 1")],
    "lgpl-3.0-header": [_gnu("lesser general", "3")],
    "mpl-2.0-header": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0"],
    "cc-by-nc-4.0-notice": ["licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0", "creative commons attribution noncommercial 4 0 [[international]]"],
    "all-rights-reserved": ["copyright {{0-}} all rights reserved"],
}

_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> tuple[bytes, list[bytes]]:
    """The text with ASCII letters lower-cased and every other ASCII character but digits as a space, and its words."""
    folded = text.translate(_FOLD)
    return folded, folded.split()


_CONDITIONS = frozenset(w.encode() for w in CONDITIONS)


def taken(word: bytes) -> tuple[bytes | None, ...]:
    """What leads on from a state at a word: the word itself and, unless it states a condition, a region."""
    return (word,) if word in _CONDITIONS else (word, None)


class Automaton:
    """States are positions in a template; a word leads from state to state, an optional region can be skipped, and a
    replaceable region takes words within its bounds, but none of CONDITIONS. A text is accepted where all mandatory words
    match exactly."""

    def __init__(self, template: str):
        self.next: list[dict[bytes | None, list[int]]] = [{}]
        self.skip: list[list[int]] = [[]]
        opened: list[int] = []
        self.need: set[bytes] = set()
        now = 0
        for part in re.findall(r"\[\[|\]\]|\{\{\d+-\d*\}\}|[^\s\[\]{}]+", template):
            if part == "[[":
                opened.append(now)
            elif part == "]]":
                self.skip[opened.pop()].append(now)
            elif part.startswith("{{"):
                least, dash, most = part[2:-2].partition("-")
                steps = [now]
                for _ in range(int(most or least)):
                    now = self._add(now, None)
                    steps.append(now)
                if dash and not most:  # a state of its own that such words lead back to
                    self.next.append({None: [len(self.next)]})
                    self.skip.append([])
                    self.skip[now].append(len(self.next) - 1)
                    now = len(self.next) - 1
                for state in steps[int(least) : -1] if most else ():
                    self.skip[state].append(now)
            else:
                now = self._add(now, part.encode())
                if not opened:
                    self.need.add(part.encode())
        self.last = now
        begin = self.closure({0})
        self.first = frozenset(w for s in begin for w in self.next[s] if w is not None)
        self.key = max(self.need, key=lambda w: (len(w), w))
        if not self.first or any(None in self.next[s] for s in begin) or self.last in begin:
            raise ValueError("a template begins with a word")

    def _add(self, state: int, word: bytes | None) -> int:
        self.next.append({})
        self.skip.append([])
        self.next[state].setdefault(word, []).append(len(self.next) - 1)
        return len(self.next) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def match(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted run of words from `at`, or -1."""
        states, end = self.closure({0}), -1
        while True:
            if self.last in states:
                end = at
            if at >= len(words) or not states:
                return end
            w = words[at]
            states = self.closure({t for s in states for k in taken(w) for t in self.next[s].get(k, ())})
            at += 1

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, end) of accepted runs, each end with its earliest start. All places are followed side by side, so that a
        replaceable region of any length costs no more than its states do."""
        begin, out = self.closure({0}), []
        live: dict[int, int] = {}
        for at, w in enumerate(words):
            if w in self.first:
                for s in begin:
                    live.setdefault(s, at)
            if not live:
                continue
            after: dict[int, int] = {}
            todo = [(t, start) for s, start in live.items() for k in taken(w) for t in self.next[s].get(k, ())]
            while todo:
                t, start = todo.pop()
                if start < after.get(t, at + 1):
                    after[t] = start
                    todo += [(x, start) for x in self.skip[t]]
            live = after
            if self.last in live:
                out.append((live[self.last], at + 1))
        return out


_MARK = re.compile(r"<<(beginOptional|endOptional|var)\b(?:[^<>]|<(?!<)|>(?!>))*>>|\[\[|\]\]|\{\{\d+-?\d*\}\}")


def template_of(text: str) -> str:
    """A template from a licence's whole text, with this module's markup or that of <<beginOptional>>, <<endOptional>> and
    <<var;name="...";original="...";match="...">>: a variable is a region of one word or more, or of none if its
    pattern may match nothing. All else is folded to words like the texts that are scanned."""
    parts, at, depth = [], 0, 0
    fold = lambda t: [w.decode() for w in words_of(t.encode())[1]]
    for m in _MARK.finditer(text):
        parts += fold(text[at : m.start()])
        at, mark = m.end(), m[1] or m[0]
        depth += {"beginOptional": 1, "[[": 1, "endOptional": -1, "]]": -1}.get(mark, 0)
        if depth < 0:
            raise ValueError("an optional region ends that never began")
        if mark == "var":
            match = re.search(r'match="([^"]*)"', m[0])
            parts.append("{{0-}}" if match and re.fullmatch(match[1], "") else "{{1-}}")
        else:
            parts.append({"beginOptional": "[[", "endOptional": "]]"}.get(mark, mark))
    if depth:
        raise ValueError("an optional region never ends")
    return " ".join(parts + fold(text[at:]))


def load_templates(folder: str) -> dict[str, list[str]]:
    """Templates of all files of a folder on the driver, labelled by their names without ending; pass them to `scan`."""
    return {p.stem.lower() + "-text": [template_of(p.read_text(encoding="utf-8"))] for p in sorted(Path(folder).iterdir()) if p.is_file()}


@lru_cache(maxsize=4)
def automata(templates: tuple[tuple[str, tuple[str, ...]], ...]) -> list[tuple[str, bool, Automaton]]:
    """(label, is base, automaton) of the base phrases and of the templates."""
    own = [(label, True, Automaton(phrase)) for phrase, label in BASE.items()]
    return own + [(label, False, Automaton(t)) for label, ts in templates for t in ts]


def scan_text(text: bytes, machines: list[tuple[str, bool, Automaton]]) -> tuple[int, list[tuple[int, int, str, bool]]]:
    """The number of words and (start, end, label, is base) of the places where a template is accepted; of those of one
    template that are within each other, or differ in their start or end only, the longest."""
    folded, words = words_of(text)
    found = []
    have = None
    for label, base, a in machines:
        if a.key not in folded:
            continue
        have = have or set(words)
        if not a.need <= have:
            continue
        last = (-1, -1)
        for place in a.places(words):
            if place[0] == last[0] and not base:
                found.pop()
            found.append((*place, label, base))
            last = place
    return len(words), sorted(found)


def scan(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """docs (without their text) with n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base phrases are templates without regions. labels adds those of `templates` (TEMPLATES if none are given). score
    is 1 where a template is accepted, all of its mandatory words in their order, 0.5 where a base phrase alone stands,
    else 0. A null text is empty: no words, null first_word and last_word, empty labels. Columns of docs with the names of
    new ones are replaced, others of any name stay.
    """
    bound_batches(docs.sparkSession)
    given = tuple((k, tuple(v)) for k, v in (TEMPLATES if templates is None else templates).items())
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    keep, called = set_aside(docs, (text,), new)
    rest = [c for c in keep.columns if c != text]

    def run(batches) -> Iterator[pa.RecordBatch]:
        machines = automata(given)
        for b in small_batches(batches, text):
            rows = []
            for t in utf8(b.column(text)):
                n, found = scan_text(t, machines)
                base = [x for x in found if x[3]]
                starts = [x[0] for x in base]
                rows.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x[2] for x in base})), ",".join(sorted({x[2] for x in found})), 1.0 if len(found) > len(base) else 0.5 if base else 0.0))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [*rest, *new])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep.schema if f.name != text)
    return keep.mapInArrow(run, f"{kinds}n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").toDF(*(called[c] for c in rest), *new)


def op4(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
