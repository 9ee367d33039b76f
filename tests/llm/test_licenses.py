from __future__ import annotations

import re

import pytest

from tests.llm import cases
from tidecast.llm import licenses, queries
from tidecast.llm.licenses import BASE, TEMPLATES, compile_template, words_of


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def as_pattern(template):
    """The template as a regular expression over words joined by blanks, by another route."""
    text = template
    for mark, pattern in (("<<opt>>", "(?:"), ("<<end>>", ")?")):
        text = text.replace(mark, f" {pattern} ")
    out = ""
    for part in text.split():
        if part in ("(?:", ")?"):
            out += part
        elif m := re.fullmatch(r"<<(var|any):(\d+)>>", part):
            out += r"(?:\S+ ){%d,%s}" % (m[1] == "var", m[2])
        else:
            out += "".join(re.escape(w) + " " for w in words_of(part.encode()) and [w.decode() for w in words_of(part.encode())])
    return re.compile("(?:^|(?<= ))" + out)


def brute_force(rows):
    found = []
    for key, text in rows:
        words = plain_words(text)
        joined = " ".join(words) + " "
        places, labels, covered = [], set(), set()
        base = set()
        for template, label in BASE:
            phrase = template.split()
            for i in range(len(words) - len(phrase) + 1):
                if words[i : i + len(phrase)] == phrase:
                    places.append(i)
                    base.add(label)
                    covered |= set(range(i, i + len(phrase)))
        for template, label in TEMPLATES:
            pattern = as_pattern(template)
            at = 0
            for i, w in enumerate(words):
                if m := pattern.match(joined, at):
                    labels.add(label)
                    covered |= set(range(i, i + m[0].count(" ")))
                at += len(w) + 1
        found.append((key, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                      ",".join(sorted(base | labels)), len(covered) / len(words) if words else 0.0))
    return sorted(found, key=str)


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert cases.as_rows(queries.op9_license_scan(spark, folder)) == brute_force(rows)


def test_tricky_rows(spark):
    docs = cases.tricky(spark).select("doc_id", "text")
    extra = spark.createDataFrame(
        [(50, "Licensed under the terms of the GNU Affero General Public License, version 3 or MIT License"),
         (51, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
              "documentation files (the \"Software\"), to deal in the Software without restriction"),
         (52, "licensed under the apache license 2.0 apache license apache license"),
         (53, "SPDX-License-Identifier: Apache-2.0"), (54, "mit license"), (55, "mit. -- LICENSE")], docs.schema)
    both = docs.unionByName(extra)
    found = cases.as_rows(licenses.summary(licenses.scan(both)))
    assert found == brute_force([tuple(r) for r in both.collect()])
    assert licenses.scan(cases.empty(cases.tricky(spark))).count() == 0


def test_templates():
    automaton = compile_template("a <<opt>>b <<opt>>c<<end>><<end>> <<var:2>> d", "t")
    for text, n in (("a x d", 3), ("a b x y d", 5), ("a b c x d e", 5), ("a d", 0), ("a b d", 3), ("a c d d", 4), ("a x y z d", 0)):
        assert automaton.longest(words_of(text.encode()), 0) == n, text
    for bad in ("<<opt>>a<<end>>", "a <<opt>> b", "a <<end>>", ""):
        with pytest.raises(ValueError):
            compile_template(bad, "bad")


MIT_TEXT = """Copyright (c) 2021 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer.
 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
    disclaimer in the documentation and/or other materials provided with the distribution.
{names}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""
NAMES = """ 3. Neither the name of the Example Society nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission.
"""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
WHOLE = {
    "mit-text": MIT_TEXT, "bsd-2-clause": BSD_TEXT.format(names=""), "bsd-3-clause": BSD_TEXT.format(names=NAMES),
    "gpl-notice": GPL_TEXT, "lgpl-notice": GPL_TEXT.replace("GNU General", "GNU Lesser General"), "apache-notice": APACHE_TEXT,
}


def test_whole_licenses(spark):
    """A whole wording has its label however it is set; one that breaks off, goes on differently or changes a word has none."""
    rows, expected = [], {}

    def add(text, label):
        rows.append((len(rows), text))
        expected[rows[-1][0]] = label

    for label, text in WHOLE.items():
        add(text, label)
        add("before " + " // * ".join(text.upper().split()) + " after", label)
        add("\n".join(text.split()) + "\n" + text, label)
        words = text.split()
        add(" ".join(words[:-8]), None)
        warranty = next(i for i, w in enumerate(words) if w.lower().startswith("warrant"))
        add(" ".join(words[:warranty] + words[warranty + 1 :]), None)
        add(text.replace("disclaimed", "claimed").replace("DISCLAIMED", "CLAIMED").replace("WITHOUT", "WITH"), None)
    add(MIT_TEXT[: MIT_TEXT.index(", including")] + " except that no commercial use is permitted and all copies must be destroyed", None)
    add(BSD_TEXT[: BSD_TEXT.index("conditions")] + "conditions are met: you pay us", None)
    add(MIT_TEXT.replace("THE AUTHORS OR\nCOPYRIGHT HOLDERS", "Some One"), "mit-text")
    add(GPL_TEXT.replace("If not, see", "If not, write to the Free Software Foundation, Inc., at"), "gpl-notice")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: set(r["labels"].split(",")) & {*WHOLE, "isc", "zlib"} for r in licenses.summary(licenses.scan(docs)).collect()}
    for k, label in expected.items():
        assert found[k] == ({label} if label else set()), (k, rows[k][1])
    assert cases.as_rows(licenses.summary(licenses.scan(docs))) == brute_force(rows)


def test_every_template_matches_its_own_wording():
    for template, label in TEMPLATES:
        filled = re.sub(r"<<var:\d+>>", "somebody", re.sub(r"<<(opt|end|any:\d+)>>", "", template))
        words = words_of(filled.encode())
        automaton = compile_template(template, label)
        assert automaton.longest(words, 0) == len(words), label
        if not template.endswith(">>"):
            assert automaton.longest(words[:-1], 0) == 0, label
