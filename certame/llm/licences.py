"""License notices by conditional compression: how much a template helps to compress a block of text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The usual wordings of notices, by SPDX identifier. Disclaimers that several licenses share stand once.
AS_IS_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
AS_IS_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
AS_IS_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = f"{BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
GNU = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{end} either version {version} of the License, or (at your option) any later version."
NO_WARRANTY = "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."


def _gnu(kind: str, version: str, mark: str, end: str, *whats: str) -> tuple[str, ...]:
    """A notice of the GNU licenses: one sentence for short, its statement alone, and with the disclaimer."""
    kind = f"{kind} " if kind else ""
    of = lambda text, what: text.format(what=what, kind=kind, version=version, mark=mark, end=end)
    return (f"This work is licensed under the GNU {kind}General Public License, version {version}.", *[t for w in whats for t in (of(GNU, w), f"{of(GNU, w)} {of(NO_WARRANTY, w)}")])


TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": ("Released under the MIT License.", MIT, f"{MIT} {AS_IS_MIT}"),
    "GPL-3.0": _gnu("", "3", ":", ",", "program"),
    "GPL-2.0": _gnu("", "2", ";", ";", "program"),
    "LGPL-3.0": _gnu("Lesser", "3", ":", ",", "program", "library"),
    "LGPL-2.1": _gnu("Lesser", "2.1", ";", ";", "library"),
    "AGPL-3.0": _gnu("Affero", "3", ":", ",", "program"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", BSD_2, f"{BSD_2} {AS_IS_BSD}"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", BSD_3, f"{BSD_3} {AS_IS_BSD}"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "ISC": (ISC, f"{ISC} {AS_IS_ISC}"),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
}
#: A file may name its license in one line.
TEMPLATES = {name: (*texts, f"SPDX-License-Identifier: {name}") for name, texts in TEMPLATES.items()}
CUE = r"(?i)licen[sc]e|copyright|\(c\)|©|permission|redistribut|warrant|spdx|public domain|creative commons|\bcc0\b|\bcc by|software|sublicens|liable|liabilit|damages|merchantab|\bas[- ]is\b|written permission|misrepresent|this notice|mozilla"
#: Lines without a cue that a block may hold between two lines with one.
GAP = 4
#: Share of a block's compressed size that a template must save to be ranked, and share of its words that must match to be confirmed.
LEAST_SAVING, LEAST_WORDS = 0.25, 0.9
LEVEL = 19
#: Words that change what a notice grants, beside all numbers.
TELLING = {"nc", "nd", "sa", "by", "noncommercial", "noderivatives", "sharealike", "lesser", "affero", "cc0", "mit", "isc", "bsd", "apache", "mozilla"}
SCHEMA = "doc_id long, block int, start long, end long, license string, size_plain int, size_template int, saving double, words_missing int, words_extra int, confirmed boolean"


@lru_cache(maxsize=1)
def _compressors() -> tuple[zstandard.ZstdCompressor, list[tuple[str, str, zstandard.ZstdCompressor]]]:
    plain = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    each = [
        (name, text, zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain))
        for name, texts in TEMPLATES.items()
        for text in texts
    ]
    return zstandard.ZstdCompressor(**plain), each


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())


def telling(words: list[str]) -> set[str]:
    return {w for w in words if w in TELLING or w[0].isdigit()}


def differences(block: str, template: str) -> tuple[int, int, bool]:
    """Template words that the block lacks, block words beyond the template within the matched stretch, and whether the wording is confirmed.

    A block confirms a template if it holds LEAST_WORDS of its words in order, or is itself, but
    for as few words, a stretch of it, and if no telling word of the stretch is on one side only.
    """
    a, b = words_of(block), words_of(template)
    if not a or not b:
        return len(b), len(a), False
    runs = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    if not runs:
        return len(b), len(a), False
    same = sum(m.size for m in runs)
    in_a, in_b = a[runs[0].a : runs[-1].a + runs[-1].size], b[runs[0].b : runs[-1].b + runs[-1].size]
    whole = same >= LEAST_WORDS * len(b)
    stretch = same >= LEAST_WORDS * max(len(a), 6)
    close = len(in_a) - same <= (1 - LEAST_WORDS) * len(b) + 1
    return len(b) - same, len(in_a) - same, (whole or stretch) and close and telling(in_a) == telling(b if whole else in_b)


def blocks_of(text: str, gap: int = GAP) -> list[tuple[int, int]]:
    """Runs of lines with a cue, with up to `gap` lines between, as [start, end) of characters."""
    found: list[list[int]] = []
    at, since = 0, gap + 1
    for line in text.split("\n"):
        if _cue.search(line):
            if found and since <= gap:
                found[-1][1] = at + len(line)
            else:
                found.append([at, at + len(line)])
            since = 0
        else:
            since += 1
        at += len(line) + 1
    return [(a, b) for a, b in found]


_cue = re.compile(CUE)


@lru_cache(maxsize=1)
def _template_words() -> list[tuple[list[str], Counter]]:
    return [(w, Counter(w)) for _, text, _ in _compressors()[1] for w in [words_of(text)]]


def notices(block: str) -> list[tuple]:
    """Confirmed notices in a block that don't overlap, whatever stands beside them: (start, end, license, size_plain, size_template, saving, missing, extra).

    Around every cue a window of each template's size is laid where it fits best, and ranked by what the template saves of that window.
    """
    plain, each = _compressors()
    low = block.lower()
    spans = [m.span() for m in re.finditer(r"[a-z0-9]+(?:\.[0-9]+)*", low)]
    if len(low) != len(block) or not spans:  # lower-casing moved the places of words: keep the block's own
        spans = [m.span() for m in re.finditer(r"[A-Za-z0-9]+(?:\.[0-9]+)*", block)]
    words = [block[a:b].lower() for a, b in spans]
    starts = [a for a, _ in spans]
    cues = sorted({max(bisect_right(starts, m.start()) - 1, 0) for m in _cue.finditer(block)}) if words else []
    found = set()
    for k, (own, counts) in enumerate(_template_words()):
        slack, done = int((1 - LEAST_WORDS) * len(own)) + 1, -1
        for cue in cues:
            # windows of neighbouring cues overlap; a cue within the last notice is settled
            if cue < done:
                continue
            lo, hi = max(0, cue - len(own) - slack), min(len(words), cue + len(own) + slack)
            near = words[lo:hi]
            if (Counter(near) & counts).total() < LEAST_WORDS * len(own):
                continue
            match = SequenceMatcher(None, near, own, autojunk=False).find_longest_match()
            a, b = max(0, match.a - match.b - slack), min(len(near), match.a - match.b + len(own) + slack)
            runs = [m for m in SequenceMatcher(None, near[a:b], own, autojunk=False).get_matching_blocks() if m.size]
            if not runs or sum(m.size for m in runs) < LEAST_WORDS * len(own):
                continue
            first, last = lo + a + runs[0].a, lo + a + runs[-1].a + runs[-1].size
            if first <= cue < last or last > done:
                start, end = spans[first][0], spans[last - 1][1]
                missing, extra, confirmed = differences(block[start:end], each[k][1])
                if confirmed:
                    found.add((start, end, k, missing, extra))
                    done = last
    rows = []
    for start, end, k, missing, extra in found:
        raw = block[start:end].encode()
        alone, size = len(plain.compress(raw)), len(each[k][2].compress(raw))
        if 1 - size / alone >= LEAST_SAVING:
            rows.append((start, end, each[k][0], alone, size, 1 - size / alone, missing, extra))
    out = []
    for row in sorted(rows, key=lambda r: (r[4] - r[3], r[2], r[0])):  # what saves most first
        if all(row[1] <= o[0] or o[1] <= row[0] for o in out):
            out.append(row)
    return sorted(out)


def scan(text: str) -> list[tuple]:
    """Rows of SCHEMA, without doc_id: for each block one, or one for each notice in it."""
    plain, each = _compressors()
    out = []
    for n, (start, end) in enumerate(blocks_of(text)):
        block = text[start:end]
        raw = block.encode()
        alone = len(plain.compress(raw))
        ranked = sorted(((len(c.compress(raw)), name, template) for name, template, c in each), key=lambda x: x[:2])
        best = None
        for size, name, template in ranked:
            saving = 1 - size / alone
            if saving < LEAST_SAVING:
                break
            missing, extra, confirmed = differences(block, template)
            row = (n, start, end, name, alone, size, saving, missing, extra, confirmed)
            if confirmed:  # the best-ranked one whose wording holds
                best = row
                break
            best = best or row
        best = best or (n, start, end, None, alone, ranked[0][0], 1 - ranked[0][0] / alone, None, None, False)
        within = notices(block)
        if best[-1] and {best[3]} >= {w[2] for w in within} and len(within) < 2:
            within = []
        if not within or (best[-1] and best[3] not in {w[2] for w in within}):
            out.append(best)
        out += [(n, start + w[0], start + w[1], *w[2:], True) for w in within]
    return out


def license_blocks(docs: DataFrame) -> DataFrame:
    """A row for each candidate block in the texts of docs (doc_id, text): where it is, the license, and how it was found.

    Blocks are runs of lines with words of license notices. Each is compressed alone and
    with every template as raw dictionary; templates are ranked by what they save, and the first
    whose wording differs in few words, none of them telling (numbers, names, conditions), is confirmed. Without one the
    best-ranked is named, unconfirmed; if none saves LEAST_SAVING, license is null. Ties go to the
    license first by name. Notices within a block, beside prose or other notices, are sought in windows of each template's size and
    have a row each, with their own places. Null, empty and plain texts give no row; a null doc_id is kept; repeated rows give theirs
    each. Texts of any length are read whole; documents without a cue never leave the JVM. An empty table gives no rows; other columns, whatever their names, are left aside.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            rows = [(doc, *row) for doc, text in zip(frame["doc_id"], frame["text"], strict=True) for row in scan(text)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"doc_id": "Int64", "words_missing": "Int64", "words_extra": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").rlike(CUE)).mapInPandas(run, SCHEMA)
