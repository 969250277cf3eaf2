"""Licence scan: anchor tokens of templates, an inverted index, banded alignment."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from kinescape.llm.common import arrow_rows, slices

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met"
)
_BSD_TWO = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING "
    "IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General "
    "Public License as published by the Free Software Foundation, either version {2} of the License, or (at your "
    "option) any later version."
)

_NO_FEE = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

#: Wordings of licence notices and texts, by name.
TEMPLATES = {
    "0bsd": _NO_FEE + ". " + _ISC_WARRANTY,
    "beerware": (
        "wrote this file. As long as you retain this notice you can do whatever you want with this stuff. If we meet some "
        "day, and you think this stuff is worth it, you can buy me a beer in return"
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, "
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire "
        "statement, including the above license grant, this restriction and the following disclaimer, must be included in all "
        "copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
        "derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "mit-0": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so. " + _MIT_WARRANTY
    ),
    "postgresql": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, "
        "and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and "
        "the following two paragraphs appear in all copies."
    ),
    "wtfpl": "You just do what the fuck you want to",
    "x11-notice": (
        "shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without "
        "prior written authorization"
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."
    ),
    "agpl-3.0": "licensed under the GNU Affero General Public License, version 3",
    "agpl-3.0-header": _GNU.format("This program", "Affero ", "3"),
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied."
    ),
    "bsd": _BSD,
    "bsd-2-clause": _BSD + _BSD_TWO + _BSD_WARRANTY,
    "bsd-3-clause": _BSD + _BSD_TWO + "3. " + _BSD_NAMES + _BSD_WARRANTY,
    "bsd-4-clause": (
        _BSD + _BSD_TWO + "3. All advertising materials mentioning features or use of this software must display the "
        "following acknowledgement: This product includes software developed by the organization. 4. " + _BSD_NAMES + _BSD_WARRANTY
    ),
    "cc0-1.0": "Licensed under CC0 1.0",
    "cc0-1.0-notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work"
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "epl-2.0": "Licensed under the Eclipse Public License, Version 2.0",
    "epl-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at http://www.eclipse.org/legal/epl-2.0"
    ),
    "gpl-2.0": "licensed under the GNU General Public License, version 2",
    "gpl-2.0-header": _GNU.format("This program", "", "2"),
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": _GNU.format("This program", "", "3"),
    "isc": (
        _NO_FEE + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY
    ),
    "lgpl-2.1": "licensed under the GNU Lesser General Public License, version 2.1",
    "lgpl-2.1-header": _GNU.format("This library", "Lesser ", "2.1"),
    "lgpl-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "lgpl-3.0-header": _GNU.format("This program", "Lesser ", "3"),
    "mit": "Released under the MIT License",
    "mit-header": _MIT,
    "mit-text": (
        _MIT + ": The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. " + _MIT_WARRANTY
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
        "the author or authors of this software dedicate any and all copyright interest in the software to the public "
        "domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
        "future rights to this software under copyright law. " + _MIT_WARRANTY
    ),
}

#: Wordings that tell versions and variants apart; a match holds each with nothing in between.
HELD = {
    **{n: (w.removeprefix("Licensed under "),) for n, w in TEMPLATES.items() if n.startswith("cc") and "notice" not in n},
    **{n: ("Apache License", "2 0") for n in ("apache-2.0", "apache-2.0-header")},
    **{n: ("Eclipse Public License", "2 0") for n in ("epl-2.0", "epl-2.0-header")},
    **{
        f"{n}{end}": (f"GNU {kind}General Public License", f"version {version}")
        for n, kind, version in (
            ("agpl-3.0", "Affero ", "3"), ("gpl-2.0", "", "2"), ("gpl-3.0", "", "3"), ("lgpl-2.1", "Lesser ", "2 1"),
            ("lgpl-3.0", "Lesser ", "3"),
        )
        for end in ("", "-header")
    },
    "bsd-3-clause": ("endorse or promote products",),
    "bsd-4-clause": ("advertising materials", "endorse or promote products"),
    "isc": ("appear in all copies",),
    "mit": ("MIT License",),
    "mit-text": ("included in all copies",),
    "mpl-2.0": ("Mozilla Public License", "2 0"),
}

_KEEP = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class _Hashes(dict):
    def __missing__(self, token: bytes) -> int:
        value = xxhash.xxh64_intdigest(token, seed=4)
        if len(token) <= 32:
            if len(self) >= 500_000:
                self.clear()
            self[token] = value
        return value


_seen = _Hashes()


def token_hashes(raw: bytes) -> np.ndarray:
    tokens = raw.translate(_KEEP).split()
    return np.fromiter(map(_seen.__getitem__, tokens), np.uint64, len(tokens))


#: Words that many texts hold; they are looked up last.
_COMMON = frozenset(
    b"a all an and any are as at be by can copy do following for from if in is it may must no not of on or other that "
    b"the this to under use was with without you".split()
)


@dataclass(frozen=True)
class TemplateIndex:
    """Sorted anchor tokens, the template and place of each, and how often templates hold each token."""

    names: list[str]
    tokens: list[np.ndarray]
    marks: np.ndarray
    template: np.ndarray
    place: np.ndarray
    known: np.ndarray
    counts: np.ndarray
    held: list[list[np.ndarray]]

    @classmethod
    def made(
        cls, templates: dict[str, str], least: float = 0.8, held: dict[str, tuple[str, ...]] | None = None
    ) -> "TemplateIndex":
        """Anchors: one place more than a match may miss, so any match of ``least`` holds one of them."""
        names = sorted(templates)
        raw = [templates[n].encode().translate(_KEEP).split() for n in names]
        tokens = [token_hashes(templates[n].encode()) for n in names]
        rows = []
        for t, own in enumerate(raw):
            need = max(1, int(np.ceil(least * len(own) - 1e-9)))
            order = sorted(range(len(own)), key=lambda i: (own[i] in _COMMON or own[i].isdigit(), -len(own[i]), i))
            rows += [(int(tokens[t][i]), t, i) for i in order[: len(own) - need + 1]]
        rows.sort()
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *tokens]))
        counts = np.zeros((len(names), len(known) + 1), np.int64)
        for t, own in enumerate(tokens):
            np.add.at(counts[t], np.searchsorted(known, own), 1)
        return cls(
            names, tokens, np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64),
            np.array([r[2] for r in rows], np.int64), known, counts,
            [[token_hashes(x.encode()) for x in (held or {}).get(n, ())] for n in names],
        )

    def holds(self, t: int, part: np.ndarray) -> bool:
        """Whether each wording that a match of the template must hold stands in ``part`` as it is."""
        for own in self.held[t]:
            if len(part) < len(own) or not (np.lib.stride_tricks.sliding_window_view(part, len(own)) == own).all(axis=1).any():
                return False
        return True

    def places(self, doc: np.ndarray) -> np.ndarray:
        """Place of each token among the templates' tokens; one past the last if no template holds it."""
        if not len(self.known):
            return np.zeros(len(doc), np.int64)
        at = np.minimum(np.searchsorted(self.known, doc), len(self.known) - 1)
        return np.where(self.known[at] == doc, at, len(self.known))

    def at_most(self, t: int, places: np.ndarray) -> int:
        """Tokens of a template that a stretch can match in any order."""
        return int(np.minimum(self.counts[t], np.bincount(places, minlength=self.counts.shape[1])).sum())

    def candidates(self, doc: np.ndarray, band: float) -> list[tuple[int, int, int]]:
        """(template, first, last): stretches of the document where a template may lie."""
        if not len(doc) or not len(self.marks):
            return []
        lo, hi = np.searchsorted(self.marks, doc), np.searchsorted(self.marks, doc, side="right")
        out: list[tuple[int, int, int]] = []
        hits: dict[int, list[int]] = {}
        for i in np.flatnonzero(hi > lo):
            for m in range(lo[i], hi[i]):
                hits.setdefault(int(self.template[m]), []).append(int(i) - int(self.place[m]))
        for t, starts in hits.items():
            slack = max(3, int(band * len(self.tokens[t])))
            starts.sort()
            first = last = starts[0]
            for s in [*starts[1:], None]:
                if s is None or s - last > slack:
                    out.append((t, first - slack, last + len(self.tokens[t]) + slack))
                    first = s
                last = s
        return out


def aligned(template: np.ndarray, doc: np.ndarray, band: int) -> tuple[int, int, int]:
    """Matched tokens of the best alignment of a template within ``doc``, and its first and last token.

    The longest common subsequence within ``band`` places of the straight line that the best
    row gives; rows are computed whole, by running maxima.
    """
    rows = np.zeros((len(template) + 1, len(doc) + 1), np.int32)
    places = np.arange(len(doc))
    for i, token in enumerate(template):
        prev = rows[i]
        step = prev[:-1] + ((doc == token) & (places >= i - band) & (places <= i + len(doc) - len(template) + band))
        rows[i + 1, 1:] = np.maximum.accumulate(np.maximum(prev[1:], step))
    i, j, first, last = len(template), len(doc), -1, -1
    while i and j and rows[i, j]:
        if rows[i, j] == rows[i, j - 1]:
            j -= 1
        elif rows[i, j] == rows[i - 1, j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            first, last = j, max(last, j)
    return int(rows[-1, -1]), first, last


def scan_text(text: str | None, index: TemplateIndex, least: float, band: float) -> list[dict]:
    """Licences of a text: name, start, end (code points), coverage, best first where they overlap."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    doc = token_hashes(raw)
    found = []
    near = index.candidates(doc, band)
    places = index.places(doc) if near else None
    for t, a, b in near:
        own = index.tokens[t]
        # a long stretch of repeats is aligned in overlapping pieces of bounded size
        size, step = 3 * len(own) + 8, len(own) + 4
        for lo in range(max(0, a), max(max(0, a) + 1, b - len(own)), step):
            part = doc[lo : min(b, lo + size)]
            if index.at_most(t, places[lo : min(b, lo + size)]) / len(own) < least:
                continue
            n, first, last = aligned(own, part, max(3, int(band * len(own))))
            if len(own) and n / len(own) >= least and last - first < 2 * len(own) and index.holds(t, part[first : last + 1]):
                found.append((-n, lo + first, lo + last, t, n / len(own)))
    taken: list[tuple] = []  # apart from each other, by place
    for _, first, last, t, share in sorted(set(found)):
        at = bisect.bisect(taken, (first,))
        if (not at or taken[at - 1][1] < first) and (at == len(taken) or taken[at][0] > last):
            taken.insert(at, (first, last, t, share))
    if not taken:
        return []
    spans = [m.span() for m in _TOKEN.finditer(raw)]
    # code points that begin before each byte
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [
        {"license": index.names[t], "start": int(points[spans[first][0]]), "end": int(points[spans[last][1]]), "coverage": share}
        for first, last, t, share in taken
    ]


def scan(
    df: DataFrame,
    templates: dict[str, str] | None = None,
    least: float = 0.8,
    band: float = 0.2,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Licence wordings in each whole text: ``key``, matches array<struct<license, start, end, coverage>>.

    The rarer tokens of each template, one more than a match may miss, make an inverted index
    (the templates are code: a fixed size). Every token of a text is looked up; a hit gives a
    stretch that, if it holds enough of the template's tokens, is aligned with it, and a match
    of at least ``least`` of the template's tokens in order is reported, of ``TEMPLATES`` only
    with the wordings in ``HELD``. Of overlapping matches the one with most matched
    tokens stays. Tokens are letters and digits in lower case; starts and ends are code
    points. A null or empty text has no matches; null keys and repeated rows are kept. One
    scan, no shuffle.
    """
    kind = dict(df.dtypes)[key]
    index = TemplateIndex.made(TEMPLATES, least, HELD) if templates is None else TemplateIndex.made(templates, least)

    def work(batch):
        for part in slices(batch):
            yield {
                key: part.column(0),
                "matches": [scan_text(s, index, least, band) for s in part.column(1).to_pylist()],
            }

    schema = f"`{key}` {kind}, matches array<struct<license: string, start: long, end: long, coverage: double>>"
    return arrow_rows(df.select(key, text), schema, work)
