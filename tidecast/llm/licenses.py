"""License scans by template markup.

A template is wording with two kinds of marked regions: ``<<opt>> ... <<end>>`` may be left out as a whole
(and may hold further regions), ``<<var:N>>`` stands for one to N words of any kind, ``<<any:N>>`` for up to
N. Everything else is mandatory: a text is accepted only if it has these words, in order and unchanged. A
template is compiled into an automaton over words; all templates that start with the same word are tried
where that word stands. A license counts as given in full only by its whole wording: a text that breaks off,
goes on differently or changes a word has no such label. Case of A-Z, punctuation, markup and line breaks do not matter, as words are runs of
letters and digits.

The work is per document, without a shuffle. A document is looked at word by word only if it has all words
that some template cannot do without; for that its words are looked for in the raw text first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import rows_of, utf8

#: Places where the words of a phrase follow each other, and the phrase's label.
BASE = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# The published wording of whole licenses and of standard notices. What their authors let users fill in
# (names, addresses, clause numbers) is optional or replaceable, all else is mandatory.
MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files <<opt>>the software<<end>> to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and "
    "to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice <<opt>>including the next paragraph<<end>> shall be included in "
    "all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var:12>> be "
    "liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out "
    "of or in connection with the software or the use or other dealings in the software"
)
ISC = (
    "permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose with or without fee is "
    "hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and <<var:12>> disclaims all warranties with regard to this software including all "
    "implied warranties of merchantability and fitness in no event shall <<var:12>> be liable for any special direct "
    "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an "
    "action of contract negligence or other tortious action arising out of or in connection with the use or performance "
    "of this software"
)
ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will <<var:12>> be held liable "
    "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
    "purpose including commercial applications and to alter it and redistribute it freely subject to the following "
    "restrictions <<opt>>1<<end>> the origin of this software must not be misrepresented you must not claim that you wrote "
    "the original software if you use this software in a product an acknowledgment in the product documentation would be "
    "appreciated but is not required <<opt>>2<<end>> altered source versions must be plainly marked as such and must not be "
    "misrepresented as being the original software <<opt>>3<<end>> this notice may not be removed or altered from any "
    "source distribution"
)
_BSD_GRANT = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met <<any:1>> redistributions of source code must retain the above copyright notice this "
    "list of conditions and the following disclaimer <<any:1>> redistributions in binary form must reproduce the above "
    "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
    "provided with the distribution "
)
_BSD_NAMES = (
    "<<any:1>> neither the name of <<var:12>> nor the names of <<var:3>> contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission "
)
_BSD_DISCLAIMER = (
    "this software is provided by <<var:12>> as is and any express or implied warranties including but not limited to the "
    "implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
    "<<var:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not "
    "limited to procurement of substitute goods or services loss of use data or profits or business interruption however "
    "caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)
BSD_2 = _BSD_GRANT + _BSD_DISCLAIMER
BSD_3 = _BSD_GRANT + _BSD_NAMES + _BSD_DISCLAIMER
APACHE_NOTICE = (
    "licensed under the apache license version 2 0 <<opt>>the license<<end>> you may not use this file except in compliance "
    "with the license you may obtain a copy of the license at <<var:1>> <<opt>>www<<end>> apache org licenses license 2 0 "
    "<<any:2>> unless required by applicable law or agreed to in writing software distributed under the license is "
    "distributed on an as is basis without warranties or conditions of any kind either express or implied see the license "
    "for the specific language governing permissions and limitations under the license"
)
MPL_NOTICE = (
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
    "distributed with this file you can obtain one at <<var:1>> <<opt>>www<<end>> mozilla org mpl 2 0"
)


def gnu_notice(name: str) -> str:
    """The standard notice of a GNU license by its name without "gnu" and "license"; the program's name, the version and
    the address at its end are replaceable."""
    return (
        f"this <<var:2>> is free software you can redistribute it and or modify it under the terms of the gnu {name} license as "
        "published by the free software foundation either version <<var:2>> of the license or <<opt>>at your option<<end>> "
        "any later version <<var:3>> is distributed in the hope that it will be useful but without any warranty without "
        "even the implied warranty of merchantability or fitness for a particular purpose see the "
        f"gnu {name} license for more details you should have received a copy of the gnu {name} license along with "
        "<<var:3>> if not <<opt>>see<<end>> <<opt>>write to the free software foundation inc<<end>>"
    )


#: (template, label). Names of licenses in a sentence, then standard notices, then whole licenses.
TEMPLATES = (
    ("released under <<opt>>the terms of<<end>> the mit license", "mit-notice"),
    ("licensed under the apache license <<opt>>version<<end>> 2 0", "apache-2.0"),
    ("licensed under the <<opt>>terms of the<<end>> gnu <<opt>>lesser<<end>> <<opt>>affero<<end>> general public license "
     "<<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> version 3", "gpl-3.0"),
    ("licensed under the <<opt>>terms of the<<end>> gnu general public license "
     "<<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> version 2", "gpl-2.0"),
    ("licensed under <<opt>>the<<end>> <<opt>>creative commons<<end>> cc by nc <<opt>>license<<end>> 4 0", "cc-by-nc-4.0"),
    ("licensed under <<opt>>the<<end>> <<opt>>creative commons<<end>> cc by sa <<opt>>license<<end>> 4 0", "cc-by-sa-4.0"),
    ("licensed under <<opt>>the<<end>> <<opt>>creative commons<<end>> cc by <<opt>>license<<end>> 4 0", "cc-by-4.0"),
    ("licensed under a creative commons attribution <<opt>>noncommercial<<end>> <<opt>>sharealike<<end>> "
     "<<var:2>> international license", "cc"),
    ("spdx license identifier <<var:1>> <<any:3>>", "spdx"),
    (gnu_notice("general public"), "gpl-notice"),
    (gnu_notice("lesser general public"), "lgpl-notice"),
    (gnu_notice("affero general public"), "agpl-notice"),
    (APACHE_NOTICE, "apache-notice"),
    (MPL_NOTICE, "mpl-2.0"),
    (MIT, "mit-text"),
    (ISC, "isc"),
    (ZLIB, "zlib"),
    (BSD_2, "bsd-2-clause"),
    (BSD_3, "bsd-3-clause"),
)

_MARK = re.compile(r"<<(opt|end|var:\d+|any:\d+)>>")
#: A-Z to a-z; every other ASCII character but digits and a-z to a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text in UTF-8: runs of a-z, 0-9 and all characters beyond ASCII, A-Z lower-cased."""
    return raw.translate(_FOLD).split()


@dataclass(frozen=True)
class Automaton:
    """States are numbers from 0; ``step`` has per state the next state for a word, ``skip`` the states
    reachable without a word, ``wild`` the next state for any word."""

    label: str
    step: tuple
    skip: tuple
    wild: tuple
    final: int
    first: bytes
    needed: tuple

    def _closed(self, states: set) -> set:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def longest(self, words: list[bytes], at: int) -> int:
        """Number of words of the longest match that starts at ``at``; 0 if there is none."""
        states, best, n = self._closed({0}), 0, 0
        while states and at + n < len(words):
            word = words[at + n]
            after = {t for s in states for w, t in self.step[s] if w == word}
            after |= {t for s in states for t in self.wild[s]}
            states, n = self._closed(after), n + 1
            if self.final in states:
                best = n
        return best


def compile_template(template: str, label: str) -> Automaton:
    """Raises ValueError for open or unknown regions and for a template without a mandatory first word."""
    step: list[list] = [[]]
    skip: list[list] = [[]]
    wild: list[list] = [[]]
    opened, needed = [], []

    def state() -> int:
        step.append([])
        skip.append([])
        wild.append([])
        return len(step) - 1

    at = 0
    for i, part in enumerate(_MARK.split(template)):
        if i % 2 == 0:
            for word in words_of(part.encode()):
                new = state()
                step[at].append((word, new))
                needed += [] if opened else [word]
                at = new
        elif part == "opt":
            opened.append(at)
        elif part == "end":
            if not opened:
                raise ValueError(f"{label}: a region is closed that was not opened")
            skip[opened.pop()].append(at)
        else:
            kind, _, most = part.partition(":")
            for k in range(int(most)):
                new = state()
                wild[at].append(new)
                if k or kind == "any":
                    skip[at].append(new)
                at = new
    if opened or not step[0] or skip[0]:
        raise ValueError(f"{label}: a region is open, or the first word is not mandatory")
    return Automaton(label, tuple(map(tuple, step)), tuple(map(tuple, skip)), tuple(map(tuple, wild)), at, step[0][0][0],
                     tuple(dict.fromkeys(needed)))


class Scanner:
    """All templates together. The first ``len(base)`` are the base phrases."""

    def __init__(self, templates: tuple, base: tuple):
        self.automata = [compile_template(t, name) for t, name in (*base, *templates)]
        self.base = len(base)

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words; matches (automaton, first word, words), the longest of each template at a place."""
        words = words_of(raw)
        text = b" ".join(words)
        by_first: dict[bytes, list[int]] = {}
        for k, a in enumerate(self.automata):
            if all(w in text for w in a.needed):
                by_first.setdefault(a.first, []).append(k)
        found = []
        if by_first:
            for at, word in enumerate(words):
                for k in by_first.get(word, ()):
                    if n := self.automata[k].longest(words, at):
                        found.append((k, at, n))
        return len(words), found


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES, base: tuple = BASE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, matches (label, base, first_word, n_words), score.

    ``score`` is the share of the document's words that lie in some match, 0 without words. NULL and empty
    texts have no words and no match; repeated rows give repeated rows; an empty table an empty result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    match = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for batch in batches:
            counts, matches, scores = [], [], []
            for (raw,) in rows_of(batch, "raw"):
                n, found = scanner.scan(raw)
                covered, end = 0, 0
                for _, at, length in found:
                    covered += max(0, at + length - max(at, end))
                    end = max(end, at + length)
                counts.append(n)
                scores.append(covered / n if n else 0.0)
                matches.append([(scanner.automata[k].label, k < scanner.base, at, m) for k, at, m in found])
            named = [[dict(zip(("label", "base", "first_word", "n_words"), m)) for m in row] for row in matches]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(named, pa.list_(match)), pa.array(scores, pa.float64())],
                names=["doc_id", "n_words", "matches", "score"],
            )

    schema = (
        f"doc_id {kind}, n_words bigint, "
        "matches array<struct<label:string,base:boolean,first_word:bigint,n_words:bigint>>, score double"
    )
    return docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("raw")).mapInArrow(run, schema)


def summary(scanned: DataFrame) -> DataFrame:
    """The digest of ``scan``: counts and places of the base phrases, and the sorted labels."""
    based = F.filter("matches", lambda m: m["base"])
    places = F.transform(based, lambda m: m["first_word"])
    sorted_labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(based).cast("bigint").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), sorted_labels(based).alias("base_labels"),
        sorted_labels(F.col("matches")).alias("labels"), "score",
    )
