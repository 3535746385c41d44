"""Licence notices in text, by a trained paragraph classifier.

Sparse logistic regression over hashed word n-grams names the licence family of a
paragraph: a line, or a block of lines between blank ones, as notices are often wrapped. It is trained on the templates below, whole and damaged, and for
the class of unknown paragraphs on a bounded sample of the corpus. Probabilities are calibrated
with a model that has seen neither the templates nor the parts of the corpus on which it is judged. A prediction counts once enough of some
template of that family stands in the paragraph, or the paragraph in it.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.words import PUNCTUATION, word_hashes


# Of each public licence its names, its identifiers, and notices and characteristic paragraphs.
LICENCES = {
    "apache-2.0": (
        ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache 2 licence", "Apache-2.0 license", "Apache Software License"),
        ("Apache-2.0",),
        (
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
            "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        ),
    ),
    "mit": (
        ("MIT License", "MIT license", "MIT licence", "Expat License"),
        ("MIT",),
        (
            "Licensed under the MIT license. See the LICENSE file in the project root for full license information.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ),
    ),
    "isc": (
        ("ISC License", "ISC licence"),
        ("ISC",),
        (
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ),
    ),
    "gpl": (
        ("GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL version 2 or later", "GPLv3", "GPLv2"),
        ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
            "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        ),
    ),
    "lgpl": (
        ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPLv3", "LGPL"),
        ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
        (
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
            "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        ),
    ),
    "agpl": (
        ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPLv3", "AGPL"),
        ("AGPL-3.0-only", "AGPL-3.0-or-later"),
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        ),
    ),
    "bsd-3-clause": (
        ("3-clause BSD License", "BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-style license", "BSD license"),
        ("BSD-3-Clause",),
        (
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ),
    ),
    "bsd-2-clause": (
        ("2-clause BSD License", "BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"),
        ("BSD-2-Clause",),
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.",
        ),
    ),
    "mpl-2.0": (
        ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
        ("MPL-2.0",),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    ),
    "epl": (
        ("Eclipse Public License 2.0", "Eclipse Public License v1.0", "Eclipse Public License"),
        ("EPL-2.0", "EPL-1.0"),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/",),
    ),
    "cddl": (
        ("Common Development and Distribution License", "CDDL"),
        ("CDDL-1.0", "CDDL-1.1"),
        ("The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.",),
    ),
    "eupl": (
        ("European Union Public Licence", "EUPL v1.2"),
        ("EUPL-1.2",),
        ("Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL (the \"Licence\"); you may not use this work except in compliance with the Licence.",),
    ),
    "ms-pl": (("Microsoft Public License", "Ms-PL"), ("MS-PL",), ("This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software.",)),
    "artistic-2.0": (("Artistic License 2.0", "Artistic License", "Perl Artistic License"), ("Artistic-2.0",), ("You may use this package under the terms of the Artistic License, or under the same terms as Perl itself.",)),
    "boost": (
        ("Boost Software License", "Boost Software License, Version 1.0"),
        ("BSL-1.0",),
        ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",),
    ),
    "zlib": (
        ("zlib License", "zlib/libpng License"),
        ("Zlib",),
        (
            "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
            "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        ),
    ),
    "psf": (("Python Software Foundation License", "PSF License"), ("PSF-2.0",), ("This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\"), and the Individual or Organization (\"Licensee\") accessing and otherwise using this software in source or binary form and its associated documentation.",)),
    "postgresql": (("PostgreSQL License",), ("PostgreSQL",), ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",)),
    "ofl": (("SIL Open Font License", "SIL Open Font License, Version 1.1"), ("OFL-1.1",), ("This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at: https://openfontlicense.org",)),
    "wtfpl": (("WTFPL",), ("WTFPL",), ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",)),
    "unlicense": (
        ("Unlicense", "The Unlicense"),
        ("Unlicense",),
        (
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
            "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        ),
    ),
    "cc0": (
        ("CC0 1.0 Universal", "Creative Commons Zero", "CC0"),
        ("CC0-1.0",),
        ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal.",),
    ),
    "cc-by": (
        ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 3.0"),
        ("CC-BY-4.0", "CC-BY-3.0"),
        ("You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit, provide a link to the license, and indicate if changes were made.",),
    ),
    "cc-by-sa": (
        ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 3.0"),
        ("CC-BY-SA-4.0", "CC-BY-SA-3.0"),
        ("Text is available under the Creative Commons Attribution-ShareAlike License 4.0; additional terms may apply. CC BY-SA 4.0.",),
    ),
    "cc-by-nc": (
        ("CC BY-NC 4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
        ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"),
        ("Licensed under CC BY-NC-SA 4.0. Commercial use is not permitted.",),
    ),
    "cc-by-nd": (
        ("CC BY-ND 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
        ("CC-BY-ND-4.0", "CC-BY-NC-ND-4.0"),
        ("If you remix, transform, or build upon the material, you may not distribute the modified material.",),
    ),
    "proprietary": (
        (),
        ("LicenseRef-Proprietary",),
        (
            "All rights reserved.",
            "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
            "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
            "This software is the confidential and proprietary information of the company. You shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement.",
        ),
    ),
}
#: How a licence is named in a notice.
MENTIONS = ("Licensed under the {}.", "Released under the {}.", "This project is licensed under the terms of the {}.", "This work is licensed under {}.", "Distributed under the {}, see LICENSE for details.", "{} licensed.", "License: {}")
TEMPLATES = {
    family: tuple(texts) + tuple(f"SPDX-License-Identifier: {i}" for i in ids) + tuple(m.format(n) for n in names for m in MENTIONS) + tuple(f"{i} licensed" for i in ids)
    for family, (names, ids, texts) in LICENCES.items()
}
#: Paragraphs that use the same words for something else.
UNKNOWN = (
    "He lost his driving license after the accident and had to take the bus to work.",
    "The committee granted permission to open a new school in the general area.",
    "The software was released last year, and version 2.0 added a search field.",
    "The university is a public institution that offers free courses to any person.",
    "Copies of the report were distributed to the members without further conditions.",
    "The apache helicopter landed near the village under heavy rain.",
    "A fishing license is required by law in most parts of the country.",
    "She studied at MIT before joining the foundation as a general manager.",
)
FAMILIES = ("unknown", *TEMPLATES)

BUCKETS, GRAMS = 1 << 16, 3
#: The feature of a word that is in no template.
OTHER = BUCKETS
#: Documents of the corpus whose parts are examples of the unknown class at most, and the characters of each part.
SAMPLE_DOCS, PART = 1000, 1024
#: Damaged copies of each example: unknown ones, licence texts, and mentions of a name.
DAMAGED, EPOCHS, RATE, PENALTY = (60, 20, 2), 40, 0.5, 1e-5
#: Lines of a block at most, as more is a text and no notice, and the probability of some line from which the block is judged.
LINES, SUSPECT = 40, 0.05
#: Share of word trigrams, of the template or the paragraph, from which a prediction is confirmed.
CONFIRM = 0.6


_FOLD = bytes.maketrans((string.ascii_uppercase + string.punctuation + "\x00").encode(), (string.ascii_lowercase + " " * (len(string.punctuation) + 1)).encode())


def words(line: bytes) -> list[bytes]:
    return line.translate(_FOLD).split()


def _mixed(gram: np.ndarray) -> np.ndarray:
    return ((gram ^ (gram >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64) % BUCKETS


def _runs(tokens: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n the words at which an n-gram starts within its line, and its bucket."""
    gram = tokens.copy()
    for n in range(1, GRAMS + 1):
        if n > 1:
            gram[: gram.size - n + 1] = gram[: gram.size - n + 1] * np.uint64(0x9E3779B97F4A7C15) + tokens[n - 1 :]
        at = np.flatnonzero(room >= n)
        yield at, _mixed(gram[at])


def buckets(tokens: np.ndarray, place: np.ndarray, room: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n the lines in which an n-gram of some template starts, and its bucket; all other words share the bucket ``OTHER``.

    ``room``: words from each place to the line's end.
    """
    out = []
    for n, (at, bucket) in enumerate(_runs(tokens, room)):
        known = _in_templates()[n][bucket]
        out.append((place[at], np.where(known, bucket, OTHER)) if n == 0 else (place[at[known]], bucket[known]))
    return out


class Model(NamedTuple):
    weights: np.ndarray
    temperature: float
    threshold: float


def _tokens(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word, its line, and the words from it to the line's end."""
    tokens, start = word_hashes(text, PUNCTUATION)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(text, np.uint8) == 10), start)
    last = np.searchsorted(line, line, "right")
    return tokens, line, last - np.arange(line.size)


@cache
def _in_templates() -> list[np.ndarray]:
    """By n the buckets of the templates' n-grams."""
    out = [np.zeros(BUCKETS, bool) for _ in range(GRAMS)]
    tokens, _, room = _tokens(_text([words(t.encode()) for ts in (*TEMPLATES.values(), UNKNOWN) for t in ts]))
    for known, (_, bucket) in zip(out, _runs(tokens, room), strict=True):
        known[bucket] = True
    return out


def _margins(tokens: np.ndarray, line: np.ndarray, room: np.ndarray, lines: int, weights: np.ndarray) -> np.ndarray:
    """One row of class margins for each line; features are scaled by the square root of their number."""
    total, count = np.zeros((lines, weights.shape[1])), np.zeros(lines)
    for at, bucket in buckets(tokens, line, room):
        if at.size:
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            total[at[first]] += np.add.reduceat(weights[bucket], first, axis=0)
            count[at[first]] += np.diff(np.append(first, at.size))
    return total / np.sqrt(np.maximum(count, 1))[:, None] + weights[-1]


def _suspects(tokens: np.ndarray, line: np.ndarray, room: np.ndarray, lines: int, model: Model) -> np.ndarray:
    """Lines that may be known with a probability of ``SUSPECT``: no other line can, as each n-gram counts with what it adds at most to any family's lead."""
    lead = model.weights[:, 1:].max(1) - model.weights[:, 0]
    total, count = np.zeros(lines), np.zeros(lines)
    for at, bucket in buckets(tokens, line, room):
        total += np.bincount(at, lead[bucket], lines)
        count += np.bincount(at, minlength=lines)
    most = total / np.sqrt(np.maximum(count, 1)) + lead[-1]
    return np.flatnonzero((count > 0) & (most / model.temperature + np.log(len(FAMILIES) - 1) >= np.log(SUSPECT / (1 - SUSPECT))))


def _text(paragraphs: list[list[bytes]]) -> bytes:
    return b"\n".join(b" ".join(p) for p in paragraphs)


def margins(paragraphs: list[list[bytes]], weights: np.ndarray) -> np.ndarray:
    return _margins(*_tokens(_text(paragraphs)), len(paragraphs), weights)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _examples(seed: int, part: int | None = None) -> tuple[list[list[bytes]], list[int]]:
    """The templates and copies of them with words dropped, replaced or cut off.

    ``part`` 0: without one text and one form of mention of each family, ``part`` 1: only those.
    """
    rng = np.random.default_rng(seed)
    filler = [w for t in UNKNOWN for w in words(t.encode())]
    x, y = [], []
    for k, family in enumerate(FAMILIES):
        texts = LICENCES[family][2] if k else UNKNOWN
        for n, t in enumerate(TEMPLATES.get(family, UNKNOWN)):
            mention = k and n >= len(texts)
            apart = t.startswith(MENTIONS[1].partition("{")[0]) if mention else n == len(texts) - 1 and len(texts) > 1
            if part is not None and apart != bool(part):
                continue
            w = words(t.encode())
            x.append(w)
            y.append(k)
            for _ in range(DAMAGED[0 if not k else 2 if mention else 1]):
                kept = [filler[rng.integers(len(filler))] if rng.random() < 0.05 else v for v in w if rng.random() > 0.08]
                if len(kept) > 20 and rng.random() < 0.3:
                    cut = int(rng.integers(10, len(kept)))
                    kept = kept[:cut]
                x.append(kept or w)
                y.append(k)
    return x, y


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The rows of ``values`` summed by ``at``, which ascends."""
    out = np.zeros((n, values.shape[1]))
    if at.size:
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _weights(x: list[list[bytes]], y: np.ndarray) -> np.ndarray:
    """AdaGrad over the examples; rare families weigh as much as the many unknown paragraphs."""
    grams = buckets(*_tokens(_text(x)))
    at, bucket = np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams])
    scale = 1 / np.sqrt(np.maximum(np.bincount(at, minlength=len(x)), 1))
    used, feature = np.unique(bucket, return_inverse=True)
    by_row, by_feature = np.argsort(at, kind="stable"), np.argsort(feature, kind="stable")
    weights, bias = np.zeros((used.size, len(FAMILIES))), np.zeros(len(FAMILIES))
    seen, seen_bias = np.full(weights.shape, 1e-8), np.full(bias.shape, 1e-8)
    each, truth = 1 / np.maximum(np.bincount(y, minlength=len(FAMILIES)), 1)[y], np.eye(len(FAMILIES))[y]
    for _ in range(EPOCHS):
        z = _sums(weights[feature[by_row]], at[by_row], len(x)) * scale[:, None] + bias
        error = (_softmax(z) - truth) * each[:, None]
        slope = PENALTY * weights + _sums((error * scale[:, None])[at[by_feature]], feature[by_feature], used.size)
        seen += slope * slope
        weights -= RATE * slope / np.sqrt(seen)
        seen_bias += error.sum(0) ** 2
        bias -= RATE * error.sum(0) / np.sqrt(seen_bias)
    out = np.zeros((BUCKETS + 2, len(FAMILIES)), np.float32)
    out[used], out[-1] = weights, bias
    return out


def train(unknown: list[list[bytes]]) -> Model:
    """The weights of all examples; temperature, the lead of the unknown class and the threshold come from weights of a part of them, held against the rest."""
    unknown = [u for u in unknown if max(similarities(u).values(), default=0) < CONFIRM]
    half = {part: _examples(1, part) for part in (0, 1)}
    rows = {part: (x + unknown[part::2], np.array(y + [0] * len(unknown[part::2]))) for part, (x, y) in half.items()}
    z, truth = margins(rows[1][0], _weights(*rows[0])), rows[1][1]
    # unknown paragraphs weigh as much as all families together, which weigh the same each
    each = 1 / np.maximum(np.bincount(truth, minlength=len(FAMILIES)), 1)[truth] * np.where(truth == 0, len(FAMILIES) - 1, 1)
    right, lead = np.arange(truth.size), np.eye(len(FAMILIES))[0]
    losses = [(-float((each * np.log(_softmax((z + shift * lead) / t)[right, truth] + 1e-12)).sum()), t, shift) for t in np.geomspace(0.1, 5, 20) for shift in np.arange(0, 8.1, 0.5)]
    _, temperature, shift = map(float, min(losses))
    z = z + shift * lead
    known = 1 - _softmax(z / temperature)[:, 0]
    threshold = float(max(0.5, np.quantile(known[truth == 0], 0.999) if (truth == 0).any() else 0.5))
    x, y = _examples(1)
    weights = _weights(x + unknown, np.array(y + [0] * len(unknown)))
    weights[-1, 0] += shift
    return Model(weights, temperature, min(threshold, 0.8))


def _grams(w: list[bytes], n: int) -> set:
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


class _Known(NamedTuple):
    """The templates' families and numbers of words, and by 2 and 3 words: how many n-grams each has, and which templates hold one."""

    family: list[str]
    sizes: list[int]
    counts: dict[int, list[int]]
    holders: dict[int, dict]


def _known_templates() -> _Known:
    rows = sorted({(f, tuple(words(t.encode()))) for f, ts in TEMPLATES.items() for t in ts})
    known = _Known([f for f, _ in rows], [len(w) for _, w in rows], {2: [], 3: []}, {2: defaultdict(list), 3: defaultdict(list)})
    for k, (_, w) in enumerate(rows):
        for n in (2, 3):
            grams = _grams(list(w), n)
            known.counts[n].append(len(grams))
            for g in grams:
                known.holders[n][g].append(k)
    return known


_KNOWN = _known_templates()


def similarities(paragraph: list[bytes]) -> dict[str, float]:
    """By family the largest share of a template's n-grams in the paragraph; a paragraph of five words or more may also be a part of a template.

    N-grams are of three words, or of two where the template or the paragraph has no more. A family without any common n-gram is left out.
    """
    best: dict[str, float] = {}
    for n in (2, 3):
        own = _grams(paragraph, n)
        for k, common in Counter(k for g in own for k in _KNOWN.holders[n].get(g, ())).items():
            if n != min(3, len(paragraph), _KNOWN.sizes[k]):
                continue
            size = min(len(own), _KNOWN.counts[n][k]) if len(paragraph) >= 5 else _KNOWN.counts[n][k]
            best[_KNOWN.family[k]] = max(best.get(_KNOWN.family[k], 0.0), common / size)
    return best


def find(texts: list[bytes], model: Model) -> list[list[dict]]:
    """The confirmed notices of each text; places are code points. Of notices that overlap the one of greater similarity stays, then the longer one."""
    out: list[list[dict]] = [[] for _ in texts]
    text = b"\n".join(texts)
    ends = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 10), len(text))
    starts = np.concatenate([[0], ends[:-1] + 1])
    tokens, line, room = _tokens(text)
    there = np.bincount(line, minlength=ends.size) > 0
    # a text's first line, and the lines at which one begins, as blocks end there and at lines without words
    first = np.cumsum([0] + [t.count(b"\n") + 1 for t in texts])
    limits = np.unique(np.concatenate([np.flatnonzero(~there), first]))
    few = _suspects(tokens, line, room, ends.size, model)
    own = np.isin(line, few)
    p = _softmax(_margins(tokens[own], np.searchsorted(few, line[own]), room[own], few.size, model.weights) / model.temperature)
    rows = [(k, k + 1, q) for k, q in zip(few.tolist(), p, strict=True) if 1 - q[0] >= model.threshold]
    blocks = set()
    for k in few[1 - p[:, 0] >= SUSPECT].tolist():
        n = int(np.searchsorted(limits, k, "right"))
        a, b = int(limits[n - 1]), int(limits[n]) if n < limits.size else ends.size
        a += not there[a]
        if 1 < b - a <= LINES:
            blocks.add((a, b))
    if blocks := sorted(blocks):
        judged = _softmax(margins([words(text[starts[a] : ends[b - 1]]) for a, b in blocks], model.weights) / model.temperature)
        rows += [(a, b, q) for (a, b), q in zip(blocks, judged, strict=True) if 1 - q[0] >= model.threshold]
    for a, b, q in rows:
        family = int(q[1:].argmax()) + 1
        close = similarities(words(text[starts[a] : ends[b - 1]])).get(FAMILIES[family], 0.0)
        if close >= CONFIRM:
            t = int(np.searchsorted(first, a, "right")) - 1
            begin = int(starts[first[t]])
            out[t].append({"paragraph": a - int(first[t]), "start": int(starts[a]) - begin, "end": int(ends[b - 1]) - begin, "family": FAMILIES[family], "probability": float(q[family]), "similarity": min(1.0, close)})
    for t, text in enumerate(texts):
        kept: list[dict] = []
        for n in sorted(out[t], key=lambda n: (-n["similarity"], n["start"] - n["end"], n["start"])):
            if all(n["end"] <= o["start"] or n["start"] >= o["end"] for o in kept):
                kept.append(n)
        for n in kept:
            before = len(text[: n["start"]].decode("utf-8", "replace"))
            n["start"], n["end"] = before, before + len(text[n["start"] : n["end"]].decode("utf-8", "replace"))
        out[t] = sorted(kept, key=lambda n: n["start"])
    return out


NOTICE = T.StructType([
    T.StructField("paragraph", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType()),
])
_ARROW = pa.list_(pa.struct([("paragraph", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))
#: Texts whose paragraphs are classified together, in bytes.
TOGETHER = 2_000_000


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Train with parts of at most ``sample_docs`` documents, chosen by a hash, as unknown paragraphs."""
    key = F.xxhash64(F.lit("licence"), "doc_id", F.substring("text", 1, PART))
    part = F.expr(f"substring(text, cast(1 + pmod(xxhash64(text), greatest(length(text) - {PART}, 1)) as int), {PART})")
    # by their hash about twice as many as are wanted, so that what tasks send doesn't grow with their number
    share = min(1.0, 2 * sample_docs / max(1, docs.count()))
    few = docs.where(F.col("text").isNotNull() & (F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30))))
    rows = few.select(part.alias("part")).orderBy(F.xxhash64("part"), "part").limit(sample_docs).collect()
    unknown = [w for r in rows for line in r.part.encode().split(b"\n") if len(w := words(line)) >= 3]
    return train(unknown)


def notices(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Confirmed notices: ``doc_id, paragraph, start, end, family, probability, similarity``.

    ``docs`` has ``doc_id, text``; other columns are not looked at. ``paragraph`` is the number of the notice's first line from 0; its end is exclusive. A text may have
    several notices, which never overlap; of equal similarities the longer notice counts, then the earlier one. Texts of any length are read whole. Repeated rows and null ids give
    notices like any other row; null and empty texts and an empty table give none.
    """
    shared = spark.sparkContext.broadcast(model or fit(docs))

    @F.arrow_udf(T.ArrayType(NOTICE))
    def found(texts: pa.Array) -> pa.Array:
        out, group, size = [], [], 0
        for t in texts:
            group.append(t.as_py() or b"")
            size += len(group[-1])
            if size > TOGETHER:
                out += find(group, shared.value)
                group, size = [], 0
        return pa.array(out + find(group, shared.value), _ARROW)

    return docs.select("doc_id", F.explode(found(F.col("text").cast("binary"))).alias("n")).select("doc_id", "n.*")
