"""License scans by template markup.

A template is wording with markup: ``[[ ... ]]`` encloses an optional region, ``<<n>>`` stands for a replaceable one of up
to n words, and ``{{a|b}}`` for alternatives. Templates are compiled into one token automaton: states are positions in
the templates, a replaceable region is a counted loop, an optional one a bypass. A stretch of a text is
accepted where its mandatory words follow each other exactly; whatever stands before and after may be anything.

Short licenses (MIT, MIT-0, both BSD, ISC, 0BSD, BSL, zlib, Unlicense) are compiled as whole texts from the grant to the last word, so a changed
condition or a missing one is not accepted and the two BSD licenses are told apart. Of the long ones (Apache, GNU, Mozilla, Creative Commons) the notices are, with
their versions, as these stand in files and not the texts themselves.

Defined results: a null or empty text has no words, no labels and score 0; an empty table gives no rows; repeated rows stay; ids
that are null stay null; very long texts are read once; further input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from tablewright.llm.common import of, texts_of

#: Phrases that name a license outright.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The public license texts from their grant on, and the notices that licenses ask for. Copyright lines and titles are no part of them.
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and {{noninfringement|non infringement}} in no event shall the {{authors or copyright holders|authors|copyright holders}} be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_BEGIN = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_NAME = (
    "[[3]] neither the {{name of|names of}} <<8>> nor the names of {{its|their|the}} contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission "
)
_BSD_END = (
    "this software is provided by the <<8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the <<8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_OBTAINED = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"
_LOSS = (
    "the author {{disclaims|disclaim}} all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the {{author|authors|copyright holder}} be liable for "
    "any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
    "arising out of or in connection with the use or performance of this software"
)
_GNU = "{{is free software|are free software}} you can redistribute {{it|them}} and or modify {{it|them}} under the terms of the gnu {name} as published by the free software foundation "
_GNU_LATER = "either version {version} of the license or [[at your option]] any later version"
_GNU_ONLY = "{{version {version} of the license|version {version}}}"


def _gnu(name: str, version: str, later: bool) -> str:
    return (_GNU + (_GNU_LATER if later else _GNU_ONLY)).replace("{name}", name).replace("{version}", version)


#: Templates, by label: whole texts, notices, and short forms.
TEMPLATES = {
    "0bsd-text": f"{_OBTAINED} the software is provided as is and {_LOSS}",
    "agpl-3.0-or-later-notice": _gnu("affero general public license", "3", True),
    "apache-2.0-header": (
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "{{http|https}} www apache org licenses license 2.0 [[html]] [[txt]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "apache-2.0-notice": "licensed under the apache license [[,]] version 2.0 [[the license]]",
    "bsd-2-clause-text": _BSD_BEGIN + _BSD_END,
    "bsd-3-clause-text": _BSD_BEGIN + _BSD_NAME + _BSD_END,
    "bsl-1.0-text": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display "
        "distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following "
        "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part "
        "and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement "
        "in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software"
    ),
    "cc-by-4.0-notice": "{{licensed|released|available}} under [[a|the|creative commons]] <<3>> {{cc by|attribution}} 4.0",
    "cc-by-nc-4.0-notice": "{{licensed|released|available}} under [[the]] [[a]] [[creative commons]] cc by nc 4.0 [[international]] [[license]]",
    "gpl-2.0-or-later-notice": _gnu("general public license", "2", True),
    "gpl-2.0-only-notice": _gnu("general public license", "2", False),
    "gpl-3.0-notice": "[[this]] {{work|program|file|software}} is licensed under the gnu general public license [[,]] [[as published by the free software foundation]] version 3",
    "gpl-3.0-or-later-notice": _gnu("general public license", "3", True),
    "gpl-3.0-only-notice": _gnu("general public license", "3", False),
    "isc-text": f"{_OBTAINED} provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {_LOSS}",
    "lgpl-2.1-or-later-notice": _gnu("lesser general public license", "2.1", True),
    "lgpl-3.0-or-later-notice": _gnu("lesser general public license", "3", True),
    "mit-0-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this <<4>> and associated documentation files [[the software]] to deal in the software without restriction including without limitation "
        f"the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so {_AS_IS}"
    ),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this <<4>> and associated documentation files [[the software]] to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        f"the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software {_AS_IS}"
    ),
    "mit-notice": "{{released|licensed|distributed|available}} under the [[terms of the]] mit license",
    "mpl-2.0-header": (
        "this source code form is subject to the terms of the mozilla public license v [[.]] 2.0 if a copy of the mpl was not distributed with this file you can obtain one at {{http|https}} [[www]] mozilla org mpl 2.0"
    ),
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v [[.]] 2.0",
    "unlicense-text": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights "
        "to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose "
        "and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software"
    ),
    "zlib-text": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation "
        "would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "[[3]] this notice may not be removed or altered from any source distribution"
    ),
}

#: Bytes outside words become blanks, A to Z lower case; bytes of longer characters belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A to Z in lower case."""
    return text.encode().translate(FOLD).split()


MARKUP = re.compile(r"\[\[(.*?)\]\]|<<(\d+)>>|\{\{(.*?)\}\}", re.S)


class Automaton:
    """All templates as one machine over words.

    ``arcs[s]`` lists (word or None for any word, next state); ``free[s]`` lists states reached without a word.
    """

    def __init__(self, templates: dict[str, str]):
        self.arcs: list[list[tuple[bytes | None, int]]] = []
        self.free: list[list[int]] = []
        self.final: dict[int, str] = {}
        self.entry: dict[bytes, set[int]] = {}
        self.total: dict[str, int] = {}
        self.done: list[int] = []
        self.label: list[str] = []
        for label, markup in sorted(templates.items()):
            self._compile(label, markup)
        self.closures = [self._closure(s) for s in range(len(self.arcs))]
        #: For every word the states after it, where a template may begin with it.
        for start in self.starts:
            for s in self.closures[start]:
                for word, to in self.arcs[s]:
                    if word is not None:
                        self.entry.setdefault(word, set()).update(self.closures[to])

    def _state(self, label: str, done: int) -> int:
        self.arcs.append([])
        self.free.append([])
        self.done.append(done)
        self.label.append(label)
        return len(self.arcs) - 1

    def _chain(self, at: int, words: list[bytes], mandatory: bool) -> int:
        for word in words:
            to = self._state(self.label[at], self.done[at] + mandatory)
            self.arcs[at].append((word, to))
            at = to
        return at

    def _compile(self, label: str, markup: str) -> None:
        at = start = self._state(label, 0)
        place = 0
        for m in [*MARKUP.finditer(markup), None]:
            at = self._chain(at, words_of(markup[place : m.start() if m else None]), True)
            if m is None:
                break
            place = m.end()
            if m[2]:  # up to so many words, whichever
                ends = [at]
                for _ in range(int(m[2])):
                    to = self._state(label, self.done[at])
                    self.arcs[ends[-1]].append((None, to))
                    ends.append(to)
                join = self._state(label, self.done[at])
                for s in ends:
                    self.free[s].append(join)
            else:
                options = [words_of(x) for x in (m[1] or m[3]).split("|")]
                ends = [self._chain(at, x, m[3] is not None) for x in options if x]
                join = self._state(label, max([self.done[s] for s in ends], default=self.done[at]))
                for s in ends + [at] * (m[1] is not None):
                    self.free[s].append(join)
            at = join
        self.final[at] = label
        self.total[label] = max(self.done[at], 1)
        self.starts = [*getattr(self, "starts", []), start]

    def _closure(self, state: int) -> tuple[int, ...]:
        out, todo = {state}, [state]
        while todo:
            for to in self.free[todo.pop()]:
                if to not in out:
                    out.add(to)
                    todo.append(to)
        return tuple(sorted(out))

    def match(self, words: list[bytes]) -> tuple[dict[str, list[tuple[int, int]]], float]:
        """Accepted stretches by label (word positions, end exclusive), and the largest share of a template's mandatory words met."""
        found: dict[str, list[tuple[int, int]]] = {}
        best = 0.0
        live: dict[int, int] = {}  # state -> the first word of the stretch that led to it
        entry = self.entry
        for i, word in enumerate(words):
            begin = entry.get(word)
            if not live and begin is None:
                continue
            after: dict[int, int] = {}
            for s, first in live.items():
                for w, to in self.arcs[s]:
                    if w is None or w == word:
                        for t in self.closures[to]:
                            if after.get(t, i) >= first:
                                after[t] = first
            for t in begin or ():
                after.setdefault(t, i)
            live = after
            for s, first in live.items():
                label = self.label[s]
                best = max(best, min(1.0, self.done[s] / self.total[label]))
                if s in self.final:
                    found.setdefault(label, []).append((first, i + 1))
        return found, 1.0 if found else best


_automata: dict[tuple, Automaton] = {}


def automaton(templates: dict[str, str]) -> Automaton:
    """The worker's automaton, compiled once."""
    key = tuple(sorted(templates.items()))
    if key not in _automata:
        _automata[key] = Automaton(templates)
    return _automata[key]


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases.items():
        parts = phrase.encode().split()
        at = -1
        for _ in range(words.count(parts[0])):
            at = words.index(parts[0], at + 1)
            if words[at : at + len(parts)] == parts:
                out.append((at, label))
    return sorted(out)


def scan_licenses(
    docs: DataFrame, *, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the accepted stretches.

    score is 1 where a template is accepted, else the largest share of a template's mandatory words that the text
    goes through in order, and never less than 0.5 where a phrase stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(templates)
        firsts = {p.encode().split()[0] for p in phrases}
        for batch in batches:
            for start, texts in texts_of(batch):
                rows = []
                for text in texts:
                    words = words_of(text)
                    seen = set(words)
                    base = phrase_places(words, phrases) if not firsts.isdisjoint(seen) else []
                    found, score = machine.match(words) if not machine.entry.keys().isdisjoint(seen) else ({}, 0.0)
                    named = {label for _, label in base}
                    places = [p for p, _ in base]
                    stretches = sorted((a, b, label) for label, own in found.items() for a, b in own)
                    rows.append((
                        len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(named)),
                        ",".join(sorted(named | found.keys())), max(score, 0.5 * bool(base)), ",".join(f"{x}:{a}:{b}" for a, b, x in stretches),
                    ))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "stretches"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
    plain = docs.select(of(docs, id_col).alias("doc_id"), of(docs, text_col).cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, stretches string"
    return plain.mapInArrow(run, schema)
