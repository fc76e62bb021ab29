"""License scans: winnowed fingerprints pick candidate templates, banded alignment confirms.

Templates are few and small; their inverted index of fingerprints goes to the executors. Texts
are scanned whole, in one pass and without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.shingles import scramble

_WORD = re.compile(r"\w+")

#: Names and wordings of public licenses (fixed values).
TEMPLATES = {
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0-notice": "Licensed under CC0 1.0.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}
#: Complete texts, one file each.
TEMPLATES |= {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted((resources.files("gradus.llm") / "license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
#: Words that tell a template from its variants: each of these runs must be in an occurrence as it is.
COMPULSORY = {
    "gpl-2.0-header": ["GNU General Public License", "version 2 of"], "gpl-3.0-header": ["GNU General Public License", "version 3 of"],
    "lgpl-2.1-header": ["GNU Lesser General Public License", "version 2.1 of"], "lgpl-3.0-header": ["GNU Lesser General Public License", "version 3 of"],
    "agpl-3.0-header": ["GNU Affero General Public License", "version 3 of"], "apache-2.0-header": ["Apache License, Version 2.0"], "mpl-2.0-header": ["Mozilla Public License, v. 2.0"],
    "apache-2.0": ["Apache License Version 2.0, January 2004"], "artistic-1.0": ["Artistic License"], "cc0-1.0": ["CC0 1.0 Universal"], "mpl-1.1": ["Mozilla Public License Version 1.1"], "mpl-2.0": ["Mozilla Public License Version 2.0"],
    "gfdl-1.2": ["GNU Free Documentation License Version 1.2"], "gfdl-1.3": ["GNU Free Documentation License Version 1.3"],
    "gpl-1.0": ["GNU General Public License Version 1"], "gpl-2.0": ["GNU General Public License Version 2"], "gpl-3.0": ["GNU General Public License Version 3"],
    "lgpl-2.0": ["GNU Library General Public License Version 2"], "lgpl-2.1": ["GNU Lesser General Public License Version 2.1"], "lgpl-3.0": ["GNU Lesser General Public License Version 3"],
    "bsd-3-clause": ["may be used to endorse or promote products"],
}


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each window (the rightmost, if tied). A shared run of
    window + gram - 1 words is sure to share a fingerprint (Schleimer et al., 2003)."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(n - window + 1) + window - 1 - np.argmin(views[:, ::-1], axis=1))


def align(text: np.ndarray, template: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(words matched, first and last matched word of text): the longest common subsequence of
    template and text within band diagonals of shift, of those the one that ends first."""
    low, width = shift - band, 2 * band + 1
    best = np.zeros(width + 1, dtype=np.int64)
    first = np.full(width + 1, -1, dtype=np.int64)
    top = (0, -1, -1)
    for i, w in enumerate(template.tolist()):
        # Diagonal d of row i is text word i + low + d; what was "up" lies at d + 1.
        at = np.arange(width) + i + low
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, dtype=bool)
        same[inside] = text[at[inside]] == w
        new, begun = np.zeros(width + 1, dtype=np.int64), np.full(width + 1, -1, dtype=np.int64)
        diagonal, up = best[:width], best[1:]
        take = same & (diagonal + 1 >= up)
        new[:width] = np.where(take, diagonal + 1, np.maximum(up, 0))
        begun[:width] = np.where(take, np.where(diagonal > 0, first[:width], at), first[1:])
        run = np.maximum.accumulate(new[:width])
        source = np.maximum.accumulate(np.where(new[:width] == run, np.arange(width), 0))
        fresh = np.flatnonzero(take & (new[:width] == run))
        if len(fresh) and (m := int(new[fresh].max())) > top[0]:
            d = int(fresh[new[fresh] == m][0])
            top = (m, int(begun[d]), int(at[d]))
        begun[:width] = begun[:width][source]
        new[:width] = run
        best, first = new, begun
    return top


class Templates:
    """Words, fingerprints and lengths of the templates."""

    def __init__(self, texts: dict[str, str], gram: int = 3, window: int = 2, band: int = 12, whole_below: int = 20, compulsory: dict[str, list[str]] | None = None):
        self.gram, self.window, self.band, self.whole_below = gram, window, band, whole_below
        self.word: dict[str, int] = {}
        self.names = sorted(texts)
        self.words = [np.array([self.word.setdefault(w, len(self.word)) for w in _WORD.findall(texts[n].lower())], dtype=np.int64) for n in self.names]
        must = COMPULSORY if compulsory is None else compulsory
        self.must = [[np.array([self.word.setdefault(w, len(self.word)) for w in _WORD.findall(run.lower())], dtype=np.int64) for run in must.get(n, ())] for n in self.names]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            grams = self.grams(words)
            for at in winnow(grams, window).tolist():
                self.index.setdefault(int(grams[at]), []).append((k, at))

    def grams(self, words: np.ndarray) -> np.ndarray:
        """Hash of each run of words; runs with a word that no template has sort last."""
        n = len(words) - self.gram + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        h, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
        with np.errstate(over="ignore"):
            for k in range(self.gram):
                part = words[k : k + n]
                known &= part >= 0
                h = scramble(h * np.uint64(0x100000001B3) + part.astype(np.uint64))
        return np.where(known, h >> np.uint64(1), np.uint64(2**64 - 1))

    def scan(self, text: str | None, least: float) -> list[tuple]:
        """(template, coverage, start and end in characters, fingerprints) of each occurrence."""
        if not text:
            return []
        get = self.word.get
        words = np.array([get(w, -1) for w in _WORD.findall(text.lower())], dtype=np.int64)
        grams = self.grams(words)
        seeds: dict[int, list[tuple[int, int]]] = {}
        # Only windows within a run of known words can matter; elsewhere the smallest is "unknown".
        for at in winnow(grams, self.window).tolist() if (grams != np.uint64(2**64 - 1)).any() else ():
            for k, mine in self.index.get(int(grams[at]), ()):
                seeds.setdefault(k, []).append((at - mine, at))
        found, spans = [], None
        for k, hits in sorted(seeds.items()):
            hits.sort()
            template = self.words[k]
            band = min(max(self.band, len(template) // 50), 1 + len(template) // 4)
            short = len(template) < self.whole_below
            needed = len(template) if short else least * len(template)
            own = np.bincount(template, minlength=len(self.word))
            begin = 0
            while begin < len(hits):
                # Seeds within a band's width belong to one occurrence.
                until = bisect_right(hits, (hits[begin][0] + band, len(words)), begin)
                near, begin = hits[begin:until], until
                shift = near[len(near) // 2][0]
                start = max(0, shift - band)
                part = words[start : shift + len(template) + band + 1]
                # No alignment matches more words than both have.
                if np.minimum(own, np.bincount(part[part >= 0], minlength=len(self.word))).sum() < needed:
                    continue
                matched, first, last = align(part, template, shift - start, band)
                # In a short notice the one word that differs, or is put in, is likely the license's name.
                if matched >= needed and not (short and last - first >= len(template)) and all(_has_run(part[first : last + 1], run) for run in self.must[k]):
                    if spans is None:
                        spans = [m.span() for m in _WORD.finditer(text if len(text.lower()) == len(text) else text.lower())]
                    found.append((self.names[k], matched / len(template), spans[start + first][0], spans[start + last][1], len(near), matched))
        return [f[:5] for f in _without_inner(found)]


def _has_run(words: np.ndarray, run: np.ndarray) -> bool:
    return len(words) >= len(run) and bool((np.lib.stride_tricks.sliding_window_view(words, len(run)) == run).all(axis=1).any())


def _without_inner(found: list[tuple]) -> list[tuple]:
    """An occurrence within a longer one, or with fewer words of the same span, isn't told again."""
    out: list[tuple] = []
    end = -1
    # By start, the longer first: what ends within those before lies within one of them.
    for f in sorted(set(found), key=lambda f: (f[2], -f[3], -f[5], -f[1], f[0])):
        if f[3] > end:
            out.append(f)
            end = f[3]
    return sorted(out, key=lambda f: (f[2], f[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, max_template_bytes: int = 32 << 20, **kwargs) -> DataFrame:
    """doc_id, template, coverage, span_start, span_end (characters), fingerprints of each license in docs.

    Coverage is the share of the template's words that the alignment matches: at least `least`, and all
    of them, with none between, in templates of fewer than whole_below words. An occurrence has all
    compulsory runs of its template. Null or empty
    texts hold none; repeated rows each have their rows; an empty table gives an empty result.
    Templates above max_template_bytes are refused: they go to every executor.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(map(len, templates.values())) > max_template_bytes:
        raise ValueError("templates are too large to be sent to every executor; scan with parts of them")
    held = docs.sparkSession.sparkContext.broadcast(Templates(templates, **kwargs))

    def run(batches):
        for batch in batches:
            found = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in held.value.scan(t, least)]
            cols = list(zip(*found, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "template", "coverage", "span_start", "span_end", "fingerprints"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, template string, coverage double, span_start long, span_end long, fingerprints long")
