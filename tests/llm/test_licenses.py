"""Licenses in their original wording, however they are wrapped and commented."""

import textwrap

import pytest
from pyspark.sql import functions as F

from minutebook.llm import licenses, queries

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
ENDORSE = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
DISCLAIMER = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def gpl(kind, version):
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details.

You should have received a copy of the GNU {kind} Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""


MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
UNLICENSE = "This is free and unencumbered software released into the public domain."
TEXTS = {"MIT": MIT, "BSD-2-Clause": BSD2 + DISCLAIMER, "BSD-3-Clause": BSD2 + ENDORSE + DISCLAIMER, "Apache-2.0": APACHE, "GPL-3.0": gpl("General", "3"),
         "GPL-2.0": gpl("General", "2"), "LGPL-3.0": gpl("Lesser General", "3"), "LGPL-2.1": gpl("Lesser General", "2.1"),
         "AGPL-3.0": gpl("Affero General", "3"), "MPL-2.0": MPL, "ISC": ISC, "Unlicense": UNLICENSE}
SPDX = {"Apache-2.0": "Apache-2.0", "MIT": "MIT", "BSD-3-Clause": "BSD-3-Clause", "BSD-2-Clause": "BSD-2-Clause", "ISC": "ISC", "GPL-3.0": "GPL-3.0-or-later",
        "GPL-2.0": "GPL-2.0-only", "LGPL-3.0": "LGPL-3.0", "LGPL-2.1": "LGPL-2.1-only", "AGPL-3.0": "AGPL-3.0-only", "MPL-2.0": "MPL-2.0",
        "CC-BY-NC-SA": "CC-BY-NC-SA-4.0", "CC-BY-NC": "CC-BY-NC-4.0", "CC-BY-SA": "CC-BY-SA-4.0", "CC-BY": "CC-BY-4.0", "CC0-1.0": "CC0-1.0", "Unlicense": "Unlicense"}


def wrapped(text, width, mark):
    lines = [line for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""])]
    return "\n".join((mark + line).rstrip() for line in lines)


def names(text):
    return licenses.matched(licenses.identifiers(text))[0]


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_original_texts_wrapped_and_commented(name):
    for width in (30, 76, 10_000):
        for mark in ("", "# ", "// ", " * ", "-- ", "; "):
            body = wrapped(TEXTS[name], width, mark)
            for text in (body, f"{mark}Copyright (c) 2020 Ann Lee. All rights held.\n{mark}\n{body}", "Some prose before it.\n" + body + "\nAnd after.",
                         "/*\n" + body + "\n */\nint x;"):
                assert names(text) == [name], (width, mark, text[:300], licenses.identifiers(text))


@pytest.mark.parametrize("name", sorted(SPDX))
def test_spdx_lines_and_short_notes(name):
    for mark, end in (("", ""), ("// ", ""), ("# ", ""), ("/* ", " */"), ("<!-- ", " -->")):
        assert names(f"{mark}SPDX-License-Identifier: {SPDX[name]}{end}\ncode") == [name]
    note = dict((n, notes[0]) for n, notes, _ in licenses.NAMES)[name]
    for text in (f"Released under the {note}.", f"words before\nThis work is licensed under the {note.title()}.\nwords after", f"Prose. Distributed under {note}! More."):
        assert names(text) == [name]


def test_prose_and_parts_of_sentences_give_no_license():
    for text in ("credit in the public domain of knowledge", "She took the license exam and a copyright course.", "He works under the MIT license office.",
                 "Permission is hereby granted to leave.", "The software is provided as is.", MIT[:200], "the word spdx-license-identifier: unknown-1.0", "warranty",
                 "He said that his work was released under the MIT License back then"):
        assert names(text) == [], licenses.identifiers(text)
    assert names("ALL RIGHTS RESERVED") == ["Proprietary"] == names("Copyright 2020 Me.\nAll rights reserved.")


def test_two_licenses_and_what_stands_between():
    text = MIT.split("\n\n")[0] + "\n\nThis permission is odd.\n\n" + "\n\n".join(MIT.split("\n\n")[1:]) + "\n\nReleased under the Apache License 2.0."
    found = licenses.identifiers(text)
    assert licenses.matched(found) == (["MIT", "Apache-2.0"], ["other"])


def test_rows_of_a_table(spark):
    rows = [(1, MIT), (2, None), (3, ""), (4, "Nothing here."), (None, "Released under the MIT Licence."), (5, "word " * 50_000 + ".\nLicensed under CC BY-NC 4.0.\n" + "x" * 900_000),
            (5, "Some license of ours."), (5, "Some license of ours.")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("licenses", F.lit(2))
    got = sorted(((r.doc_id or 0, r.licenses, r.sentences, r.unmatched) for r in licenses.scan_licenses(table).collect()))
    assert got == sorted([(1, "MIT", "mit-grant;mit-notice;mit-asis;mit-liability;", ""), (2, "", "", ""), (3, "", "", ""), (4, "", "", ""),
                          (0, "MIT", "ref-MIT;", ""), (5, "CC-BY-NC", "ref-CC-BY-NC;", ""), (5, "", "other;", "other;"), (5, "", "other;", "other;")])
    assert licenses.scan_licenses(table.limit(0)).count() == 0


def test_license_lines_of_the_given_table(spark):
    """The lines that the given documents hold, found by plain comparison of whole lines."""
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in queries.QUERIES["op2_sentence_rules"](spark, folder).collect()}
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(got)
    for d in docs:
        assert got[d.doc_id] == {n for line, n in lines.items() if line in d.text.split("\n")}, d.doc_id
    assert sum(map(bool, got.values())) >= 40
