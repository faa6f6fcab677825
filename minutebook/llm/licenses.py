"""License scan by sentence rules.

Texts that speak of rights are cut into fragments: comment marks go, and a
fragment ends at a stop, at a line break or at a blank line.  A known sentence
is a run of fragments whose words, without case and punctuation, are exactly
its words, so a sentence is found however it is wrapped, and not inside another
sentence.  Sentences are looked up by their words; those with a free part, such
as a name, by their fixed beginning first.  What speaks of rights and is not
known is ``other``.  The identifiers of a text, in order, are then matched with
ordered rules: each takes what it matches out of the sequence, with ``other``
and copyright lines between its sentences left where they are.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutebook.llm.common import ship

ship(__name__)

# --- fixed values: sentences of public licenses, in their words; * stands for one to twelve other words ---
GPL = ("* is free software you can redistribute it and or modify it under the terms of the gnu {kind} public license as published by the "
       "free software foundation either version {version} of the license or at your option any later version")
SENTENCES = (
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
                  "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
                  "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
                  "furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-asis", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
                 "merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action "
                      "of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the "
                      "software"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
                  "that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                  "conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
                   "in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this "
                    "software without specific prior written permission"),
    ("bsd-asis", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but "
                 "not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-liability", "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but "
                      "not limited to procurement of substitute goods or services loss of use data or profits or business interruption however "
                      "caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
                      "arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("apache-header", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-copy", "you may obtain a copy of the license at *"),
    ("apache-asis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
                    "basis without warranties or conditions of any kind either express or implied"),
    ("apache-terms", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl3-free", GPL.format(kind="general", version="3")), ("gpl2-free", GPL.format(kind="general", version="2")),
    ("lgpl3-free", GPL.format(kind="lesser general", version="3")), ("lgpl21-free", GPL.format(kind="lesser general", version="2.1")),
    ("agpl3-free", GPL.format(kind="affero general", version="3")),
    ("gpl-useful", "* is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
                   "merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu general public license for more details"), ("gpl-see", "see the gnu lesser general public license for more details"),
    ("gpl-see", "see the gnu affero general public license for more details"),
    ("gpl-copy", "you should have received a copy of the gnu * license along with *"),
    ("gpl-not", "if not see *"), ("gpl-not", "if not write to *"),
    ("mpl-form", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("mpl-copy", "if a copy of the mpl was not distributed with this file you can obtain one at *"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "this * is in the public domain"), ("public-domain", "released into the public domain"),
    ("public-domain", "this * has been placed in the public domain"),
    ("all-rights", "all rights reserved"),
    ("copyright", "copyright *"), ("copyright", "c copyright *"),
)
# Names of licenses as short notes give them, and as SPDX lines do.
NAMES = (
    ("Apache-2.0", ("apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache license version 2"), ("apache 2.0",)),
    ("MIT", ("mit license", "expat license"), ("mit",)),
    ("BSD-3-Clause", ("3 clause bsd license", "bsd 3 clause license", "new bsd license", "modified bsd license"), ("bsd 3 clause",)),
    ("BSD-2-Clause", ("2 clause bsd license", "bsd 2 clause license", "simplified bsd license"), ("bsd 2 clause",)),
    ("BSD", ("bsd license",), ()),
    ("ISC", ("isc license",), ("isc",)),
    ("GPL-3.0", ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gplv3"),
     ("gpl 3.0", "gpl 3.0 only", "gpl 3.0 or later")),
    ("GPL-2.0", ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gplv2"),
     ("gpl 2.0", "gpl 2.0 only", "gpl 2.0 or later")),
    ("LGPL-3.0", ("gnu lesser general public license version 3", "lgplv3"), ("lgpl 3.0", "lgpl 3.0 only", "lgpl 3.0 or later")),
    ("LGPL-2.1", ("gnu lesser general public license version 2.1",), ("lgpl 2.1", "lgpl 2.1 only", "lgpl 2.1 or later")),
    ("AGPL-3.0", ("gnu affero general public license version 3", "agplv3"), ("agpl 3.0", "agpl 3.0 only", "agpl 3.0 or later")),
    ("MPL-2.0", ("mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0"), ("mpl 2.0",)),
    ("CC-BY-NC-SA", ("cc by nc sa", "cc by nc sa 4.0", "creative commons attribution noncommercial sharealike 4.0 international license"),
     ("cc by nc sa 4.0",)),
    ("CC-BY-NC", ("cc by nc", "cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license"), ("cc by nc 4.0",)),
    ("CC-BY-SA", ("cc by sa", "cc by sa 4.0", "creative commons attribution sharealike 4.0 international license"), ("cc by sa 4.0",)),
    ("CC-BY", ("cc by", "cc by 4.0", "creative commons attribution 4.0 international license"), ("cc by 4.0",)),
    ("CC0-1.0", ("cc0", "cc0 1.0", "cc0 1.0 universal"), ("cc0 1.0",)),
    ("Unlicense", ("unlicense",), ("unlicense",)),
)
VERBS = ("licensed", "released", "distributed", "published", "available", "provided")
SUBJECTS = ("this work is", "this software is", "this program is", "this file is", "this project is", "this code is", "this library is", "it is",
            "the code is", "the software is", "the project is", "this document is", "this is")
# License, its sentences in order; those with ? may be missing.
RULES = (
    ("Apache-2.0", "apache-header apache-copy? apache-asis? apache-terms?"),
    ("MIT", "mit-grant mit-notice? mit-asis? mit-liability?"),
    ("ISC", "isc-grant mit-asis? bsd-liability?"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse bsd-asis? bsd-liability?"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-asis? bsd-liability?"),
    ("AGPL-3.0", "agpl3-free gpl-useful? gpl-see? gpl-copy? gpl-not?"),
    ("LGPL-3.0", "lgpl3-free gpl-useful? gpl-see? gpl-copy? gpl-not?"),
    ("LGPL-2.1", "lgpl21-free gpl-useful? gpl-see? gpl-copy? gpl-not?"),
    ("GPL-3.0", "gpl3-free gpl-useful? gpl-see? gpl-copy? gpl-not?"),
    ("GPL-2.0", "gpl2-free gpl-useful? gpl-see? gpl-copy? gpl-not?"),
    ("MPL-2.0", "mpl-form mpl-copy?"),
    ("Unlicense", "unlicense"),
    *((name, f"ref-{name}") for name, _, _ in NAMES), *((name, f"spdx-{name}") for name, _, spdx in NAMES if spdx),
    ("Public-Domain", "public-domain"),
    ("Proprietary", "copyright? all-rights"),
)
SPEAKS_OF_RIGHTS = (r"licen[sc]e|copyright|warrant|redistribut|permission|rights\s+reserved|public\s+domain|spdx|creative\s+commons|"
                    r"\bcc0?\b|endorse|in\s+no\s+event|free\s+software")
# -----------------------------------------------------------------------------------------------------
OTHER = "other"
FREE = 12  # most words that * stands for
MARK = re.compile(r"^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|>+|%+|<!--|\.\.|(?i:rem\b|dnl\b))?[ \t]*")
MARK_END = re.compile(r"[ \t]*(?:\*+/|-->|\*+|#+)?[ \t\r]*$")
STOP = re.compile(r"(?<!\bv)[.!?]+(?=[\s\"')\]]|$)|[;:]?$")
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
LIST_MARK = re.compile(r"^(?:\(?(?:\d{1,2}|[a-uw-z])[.)]|[-*o•])[ \t]+")
RIGHTS = re.compile(SPEAKS_OF_RIGHTS, re.IGNORECASE)


def words(text: str) -> list[str]:
    """Words without case; "licence" and "non-infringement" in one spelling."""
    found = WORD.findall(text.lower())
    return " ".join(found).replace("licence", "license").replace("non infringement", "noninfringement").split()


def fragments(text: str) -> list[tuple[list[str], bool, str]]:
    """(words, whether a sentence surely ends after them, the piece as it stands) of each fragment."""
    out = []
    for raw in text.split("\n"):
        line = LIST_MARK.sub("", MARK_END.sub("", MARK.sub("", raw)))
        if not line.strip():
            if out:
                out[-1] = (out[-1][0], True, out[-1][2])
            continue
        at = 0
        for end in STOP.finditer(line):
            piece, stop = line[at:end.end()], end.group()[:1] in (".", "!", "?")
            at = end.end()
            if mine := words(piece):
                out.append((mine, bool(stop and end.group()), piece))
            elif out and stop:
                out[-1] = (out[-1][0], True, out[-1][2])
    return out


@cache
def known() -> tuple[dict, dict, int]:
    """Sentences by their words, templates by their first fixed words, most words of any."""
    exact, open_ = {}, {}
    spelled = list(SENTENCES)
    for name, notes, spdx in NAMES:
        for note in notes:
            for verb in VERBS:
                for under in ("under", "under the", "under a", "under the terms of the"):
                    for tail in ("", " or later", " or any later version"):
                        spelled.append((f"ref-{name}", f"{verb} {under} {note}{tail}"))
            spelled += [(f"ref-{name}", x) for x in (note, f"the {note}", f"license {note}") if "license" in x]  # a title by itself
        spelled += [(f"spdx-{name}", f"spdx license identifier {s}") for s in spdx]
    for name, sentence in spelled:
        w = tuple(sentence.split())
        subjects = [s.split() for s in SUBJECTS] if name.startswith("ref-") and w[0] in VERBS else []
        for one in [w, *(tuple(s) + w for s in subjects)]:
            if "*" in one:
                pattern = re.compile(" ".join(rf"\S+(?: \S+){{0,{FREE - 1}}}" if x == "*" else re.escape(x) for x in one))
                open_.setdefault(one[0], []).append((name, pattern, len(one) - one.count("*") + FREE * one.count("*")))
            else:
                exact.setdefault(one, name)
    longest = max([*map(len, exact), *(n for many in open_.values() for _, _, n in many)])
    return exact, open_, longest


@cache
def beginnings() -> frozenset:
    return frozenset(w[:3] for w in known()[0])


def _sentence(parts: list, i: int) -> tuple[str, int] | None:
    """(identifier, fragments used) of the longest known sentence that begins with fragment i."""
    exact, open_, longest = known()
    free = open_.get(parts[i][0][0], []) + open_.get("*", [])
    run, best = [], None
    for k in range(i, len(parts)):
        run += parts[k][0]
        if len(run) > longest:
            break
        if tuple(run) in exact:
            best = exact[tuple(run)], k - i + 1
        elif free:
            text = " ".join(run)
            best = next(((name, k - i + 1) for name, pattern, most in free if len(run) <= most and pattern.fullmatch(text)), best)
        if parts[k][1] or not free and len(run) >= 3 and tuple(run[:3]) not in beginnings():
            break
    return best


def identifiers(text: str) -> list[str]:
    """Identifiers of the sentences of a text that speak of rights, in order."""
    parts, out, i = fragments(text), [], 0
    while i < len(parts):
        found = _sentence(parts, i)
        if found:
            if found[0] != "gpl-not" or any(x.startswith("gpl") for x in out[-1:]):
                out.append(found[0])
            i += found[1]
        else:
            if RIGHTS.search(parts[i][2]) and (not out or out[-1] != OTHER or parts[i - 1][1]):
                out.append(OTHER)
            i += 1
    return out


@cache
def rules() -> list:
    between = "(?:(?:other|copyright);)*"
    made = []
    for name, sequence in RULES:
        steps = [re.escape(s.rstrip("?")) + ";" for s in sequence.split()]
        parts = [f"(?:{between}({s}))?" if q.endswith("?") and k else f"(?:({s}))?" if q.endswith("?") else (between if k else "") + f"({s})"
                 for k, (s, q) in enumerate(zip(steps, sequence.split()))]
        made.append((name, re.compile("(?<![^;])" + "".join(parts))))
    return made


def matched(names: list[str]) -> tuple[list[str], list[str]]:
    """(licenses in the order of the rules, identifiers that no rule took)"""
    left, found = "".join(n + ";" for n in names), []
    for name, pattern in rules():
        while hit := pattern.search(left):
            if name not in found:
                found.append(name)
            for g in range(pattern.groups, 0, -1):
                if hit.group(g):
                    left = left[:hit.start(g)] + left[hit.end(g):]
    return found, [x for x in left.split(";") if x]


def _scan(parts):
    for part in parts:
        rows = [identifiers(t) for t in part.column("text").to_pylist()]
        done = [matched(r) for r in rows]
        joined = lambda many: pa.array(["".join(x + ";" for x in r) for r in many], pa.string())
        yield pa.RecordBatch.from_arrays([part.column("id"), joined(rows), pa.array([",".join(d[0]) for d in done], pa.string()),
                                          joined([d[1] for d in done])], ["id", "sentences", "licenses", "unmatched"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id_col, sentences, licenses, unmatched.

    ``sentences`` are the identifiers in order, each followed by a semicolon;
    ``licenses`` the names found, in the order of the rules, joined by commas;
    ``unmatched`` the identifiers that no rule took.  Null and empty texts and
    texts that speak of no rights get empty strings.  Null and repeated ids
    are carried along.  Every row is scanned where it lies, whatever its length;
    other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    speaks = F.coalesce(F.col("text").rlike("(?i)" + SPEAKS_OF_RIGHTS), F.lit(False))
    # Only texts that speak of rights go to Python.
    told = rows.withColumn("text", F.when(speaks, F.col("text")).otherwise(""))
    return told.mapInArrow(_scan, f"id {kind}, sentences string, licenses string, unmatched string").withColumnRenamed("id", id_col)
