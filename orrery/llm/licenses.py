"""License scans: winnowed fingerprints of templates in an inverted index, then banded sequence alignment.

Templates and texts are sequences of lower-case words of letters and digits. The hash of every run of K words is a
fingerprint. Of every W of a template's fingerprints in a row the index keeps the least, so that any K + W - 1 words in a row that
a text shares with it meet in a kept one; W is as large as the words that a find is sure to share in a row allow. A template of
so few words that a find may share no run of K words with it has shorter runs, all of them kept.
The index maps a fingerprint to its places in templates; it holds the templates alone, so its size is theirs. The hits
of a text and a template fall into clusters by diagonal (place in the text minus place in the template), at most BAND wide; each with
an eighth of the template's fingerprints (one at least) is a candidate, and its stretch of the text is aligned with the template within
a band around the diagonal (match 2, mismatch and gap -1, local). An alignment reports the words of the template that it matches
exactly. Where no cluster alone reaches the coverage, clusters of any size are chained in the order of both text and template, and their
matched words and spans add up. A chain's span is at most SPAN times the template's words, and so is bounded what may stand between
its parts; for templates under FEW words one of its parts has half of them.

A template is found where matched words / template words >= `coverage`. Of overlapping finds of one template the better
stays; a template inside the span of another that is found with more matched words (of equally many, with more of its own
words) is not reported.

Edge cases: a null or empty text has no finds; equal texts have equal finds; repeated rows stay repeated; an empty table
gives no rows; further columns are ignored whatever their names. A very long text is one row of a task; as clusters and chains
are no longer than twice a template, work grows with the text's length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import mix, pieces, small_batches, texts_of

K, BAND = 3, 12
#: Longest chain of parts, as times the template's words; words of a template that counts as short.
SPAN, FEW = 2, 12
TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+")

# License texts and notices as their publishers word them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "GPL-3.0-line": "licensed under the GNU General Public License, version 3",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not
be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license
grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object
code generated by a source language processor.""",
    "BSD-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def tokens(text: bytes) -> list[bytes]:
    return TOKEN.findall(text.lower())


def fingerprints(words: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of all runs of k words."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    runs = np.zeros(n, np.uint64)
    for i in range(k):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(runs), np.arange(n)


def shared_run(n: int, coverage: float) -> int:
    """Words in a row that a text shares with a template of n words wherever coverage is reached by changing words."""
    kept = next((m for m in range(n + 1) if n and m / n >= coverage), n)
    return max(1, -(-kept // (n - kept + 1)))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash (of equal ones the last) of every `window` in a row."""
    if len(hashes) <= window:
        return np.flatnonzero(hashes == hashes.min())[-1:] if len(hashes) else np.zeros(0, np.int64)
    each = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(each)) + window - 1 - each.argmin(axis=1))


class Index:
    """Fingerprint -> (template, place), sorted arrays."""

    def __init__(self, templates: dict[str, str], coverage: float = 0.8) -> None:
        self.names = sorted(templates)
        self.words = [tokens(templates[x].encode()) for x in self.names]
        shared = [shared_run(len(words), coverage) for words in self.words]
        self.runs = [min(K, n) for n in shared]
        rows, self.needs = [], []
        for t, words in enumerate(self.words):
            hashes, at = fingerprints(words, self.runs[t])
            kept = winnow(hashes, max(1, shared[t] - K + 1))
            rows += [(int(h), t, int(a)) for h, a in zip(hashes[kept], at[kept])]
            self.needs.append(max(1, len(kept) // 8))
        rows.sort()
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.places = [(r[1], r[2]) for r in rows]

    def hits(self, hashes: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Template -> (place in the text, place in the template)."""
        out: dict[int, list[tuple[int, int]]] = {}
        lo = np.searchsorted(self.hashes, hashes)
        hi = np.searchsorted(self.hashes, hashes, side="right")
        for i in np.flatnonzero(hi > lo):
            for j in range(lo[i], hi[i]):
                t, place = self.places[j]
                out.setdefault(t, []).append((int(at[i]), place))
        return out


def align(text: list[bytes], template: list[bytes], diagonal: int, band: int = BAND) -> list[tuple[int, int]]:
    """Banded local alignment: (text place, template place) of the words matched. text[i] faces template[i - diagonal]."""
    best, found = 0, None
    before: dict[int, tuple] = {}  # template place -> score, last match as (text place, template place, match before)
    for i, word in enumerate(text):
        now: dict[int, tuple] = {}
        for j in range(max(0, i - diagonal - band), min(len(template), i - diagonal + band + 1)):
            s, m = before.get(j - 1, (0, None))
            x = (s + 2, (i, j, m)) if word == template[j] else (s - 1, m)
            for other in (before.get(j), now.get(j - 1)):
                if other and other[0] - 1 > x[0]:
                    x = (other[0] - 1, other[1])
            if x[0] > 0:
                now[j] = x
                if x[0] > best:
                    best, found = x
        before = now
    out = []
    while found:
        out.append(found[:2])
        found = found[2]
    return out[::-1]


def chains(parts: list[list[tuple[int, int]]], n: int, coverage: float) -> list[list[tuple[int, int]]]:
    """Chains of parts (in order) that reach the coverage of a template of n words, those of more words first, no part in two.

    Parts follow each other in text and template; where two overlap, the later one's words are cut. One sweep over the parts: a
    part looks back at those that begin at most SPAN * n words before it ends."""
    found, left = [], list(parts)
    while len(left) > 1:
        best: list[tuple[int, int, int, int]] = []  # of the best chain that ends with a part: words, first place, part before or -1, words of the largest part
        first = 0
        for k, part in enumerate(left):
            while left[first][0][0] < part[-1][0] + 1 - SPAN * n:
                first += 1
            here = (len(part), part[0][0], -1, len(part))
            for j in range(first, k):
                words, begin, _, largest = best[j]
                last = left[j][-1]
                rest = sum(x[0] > last[0] and x[1] > last[1] for x in part)
                if rest and words + rest > here[0] and part[-1][0] + 1 - begin <= SPAN * n:
                    here = (words + rest, begin, j, max(largest, len(part)))
            best.append(here)
        used: set[int] = set()
        before = len(found)
        for k in sorted(range(len(left)), key=lambda k: (-best[k][0], left[k][-1][0] - best[k][1])):
            if best[k][2] < 0 or best[k][0] / n < coverage or n < FEW and 2 * best[k][3] < n:
                continue
            way, at = [], k
            while at >= 0:
                way.append(at)
                at = best[at][2]
            if used.isdisjoint(way):
                used.update(way)
                pairs = list(left[way[-1]])
                for j in way[-2::-1]:
                    pairs += [x for x in left[j] if x[0] > pairs[-1][0] and x[1] > pairs[-1][1]]
                found.append(pairs)
        if len(found) == before:
            break
        left = [x for k, x in enumerate(left) if k not in used]
    return found


def clusters(hits: list[tuple[int, int]], band: int = BAND) -> list[list[tuple[int, int]]]:
    """Hits in order of diagonal, cut where the diagonal jumps or has moved by a band."""
    out: list[list[tuple[int, int]]] = []
    for at, place in sorted(hits, key=lambda x: (x[0] - x[1], x)):
        if out and at - place - (out[-1][-1][0] - out[-1][-1][1]) <= 2 and at - place - (out[-1][0][0] - out[-1][0][1]) <= band:
            out[-1].append((at, place))
        else:
            out.append([(at, place)])
    return out


class Spans:
    """Spans (name, start, stop, ...) that do not overlap, by start."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.all: list[tuple] = []

    def at(self, place: int) -> tuple | None:
        """The span that the place lies in."""
        k = bisect_right(self.starts, place) - 1
        return self.all[k] if k >= 0 and place < self.all[k][2] else None

    def add(self, x: tuple) -> bool:
        k = bisect_right(self.starts, x[1])
        free = (not k or self.all[k - 1][2] <= x[1]) and (k == len(self.all) or x[2] <= self.starts[k])
        if free:
            self.starts.insert(k, x[1])
            self.all.insert(k, x)
        return free


def finds(words: list[bytes], index: Index, coverage: float) -> list[tuple[str, int, int, int, float]]:
    """(template, first word, last word exclusive, matched words, coverage) in order of place and name."""
    found = [fingerprints(words, k) for k in sorted({K, *index.runs})]
    hits = index.hits(*map(np.concatenate, zip(*found)))
    out: list[Spans] = []
    for t, places in hits.items():
        template, of, left = index.words[t], [], []
        n = len(template)
        band = min(BAND, n // 2)  # else a short template's copy next to this one would do as well

        def aligned(group: list[tuple[int, int]], whole: bool) -> list[tuple[int, int]]:
            """Aligns the whole template around the group's diagonal, or only the stretch that the group's hits cover."""
            mid = group[len(group) // 2]
            diagonal = mid[0] - mid[1]
            lo, hi = (diagonal - band, diagonal + n + band) if whole else (min(x[0] for x in group) - K, max(x[0] for x in group) + 2 * K)
            lo, hi = max(0, lo), min(len(words), hi)
            return [(lo + i, j) for i, j in align(words[lo:hi], template, diagonal - lo, band)]

        def add(pairs: list[tuple[int, int]]) -> bool:
            share = len(pairs) / n
            if share >= coverage:
                of.append((index.names[t], pairs[0][0], pairs[-1][0] + 1, len(pairs), share))
            return share >= coverage

        for group in clusters(places, band):
            if len(group) < index.needs[t]:
                left.append((group, None))
            elif not add(pairs := aligned(group, True)):
                left.append((group, pairs))
        kept = Spans()
        for x in sorted(of, key=lambda x: (-x[3], x[1])):
            kept.add(x)
        # Words of finds are no parts of others.
        left = [x for x in left if not kept.at(x[0][0][0])]
        if len(left) > 1 and len({place for group, _ in left for _, place in group}) >= index.needs[t]:
            parts = {tuple(aligned(group, False) if pairs is None else pairs) for group, pairs in left}
            of = []
            for pairs in chains(sorted(list(x) for x in parts if x), n, coverage):
                add(pairs)
            for x in sorted(of, key=lambda x: (-x[3], x[1])):
                kept.add(x)
        out.append(kept)
    better = lambda y, x: y and y is not x and y[1] <= x[1] and x[2] <= y[2] and (y[3], y[4], y[0]) > (x[3], x[4], x[0])
    return sorted((x for kept in out for x in kept.all if not any(better(other.at(x[1]), x) for other in out)), key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, n_finds, finds, an array of (license, start, stop, matched,
    coverage); places count words of letters and digits."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dict(TEMPLATES if templates is None else templates))
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, coverage)
        for batch in batches:
            for part in pieces(batch, 1):
                n, found = [], []
                for text in texts_of(part.column(1)):
                    words = tokens(text or b"")
                    n.append(len(words))
                    found.append([dict(zip(("license", "start", "stop", "matched", "coverage"), x)) for x in finds(words, index, coverage)])
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array(found, kind)], ["doc_id", "n_tokens", "n_finds", "finds"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_finds long, finds array<struct<license:string,start:long,stop:long,matched:long,coverage:double>>")
