"""License texts found in documents by patience alignment.

Words that occur once in the text and once in the template are anchors. The longest run of anchors
in the order of both is kept, and between neighbouring anchors the gaps are aligned in the same
way, with the words that are unique there. Where a gap has no anchor left, words that agree from
its ends inwards count. Coverage is the share of the template's words that found a partner.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .rows import append, bounded_batches, schema_of, without

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

# Notices as their licences ask for them, and the openings of the licence texts. "BSD" is an
# opening that two- and three-clause texts share; it names neither.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the "
        "License."),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "GPL-2.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 2 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "LGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor "
        "the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."),
}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def longest_rise(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def _once(words: list[str], low: int, high: int) -> dict[str, int]:
    seen: dict[str, int] = {}
    for i in range(low, high):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def patience_pairs(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions (text, template) that align, rising in both."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        own = _once(template, c, d)
        here = {w: i for w, i in _once(text, a, b).items() if w in own}
        anchors = sorted((i, own[w]) for w, i in here.items())
        kept = [anchors[i] for i in longest_rise([t for _, t in anchors])]
        if not kept:
            continue
        pairs += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:])]
    return sorted(pairs)


def _windows(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Stretches of the text to align: around each dense cluster of the template's words.

    Positions of template words are joined while no gap is wider than half the template.
    """
    wanted, reach = set(template), max(4, len(template) // 2)
    found: list[list[int]] = []
    for i, w in enumerate(text):
        if w in wanted:
            if found and i - found[-1][1] <= reach:
                found[-1][1] = i
            else:
                found.append([i, i])
    return [(a, b + 1) for a, b in found]


def _stretches(text: list[str], template: list[str]) -> Iterator[tuple[int, int]]:
    """The windows and, of those longer than the template, also slices of about its length.

    A long window may hold a licence twice, so that no word of it is there once. Slices overlap, so
    that each place where the template may start is near the start of one.
    """
    step = max(1, len(template) // 4)
    for a, b in _windows(text, template):
        yield a, b
        if b - a > len(template):
            yield from ((i, min(b, i + len(template) + 2 * step)) for i in range(a, b, step))


def best_coverage(text: list[str], template: list[str]) -> tuple[float, int, int]:
    """(coverage, first, last aligned word) of the best stretch; (0, -1, -1) without any."""
    best = (0.0, -1, -1)
    for a, b in _stretches(text, template):
        if best[0] == 1:
            break
        pairs = patience_pairs(text[a:b], template)
        if pairs and len(pairs) / len(template) > best[0]:
            best = (len(pairs) / len(template), a + pairs[0][0], a + pairs[-1][0])
    return best


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8,
                  text: str = "text") -> DataFrame:
    """``docs`` with ``license`` (name of the best template or null), ``coverage`` (0 to 1),
    ``first_word`` and ``last_word`` of the aligned stretch (null without one) and ``licenses``
    (all names that reach ``least``, by falling coverage, then length, then name).

    A template is only aligned if the text holds enough of its words to reach ``least``; nothing
    else could reach it. A null, empty or wordless text has no license; so has every text for
    an empty table of templates. Of templates of equal coverage the longer wins, then the name.
    Rows stand for themselves, repeated ones get equal results; texts are read whole. Columns of
    ``docs`` with the new names are replaced.
    """
    made = {"license": "string", "coverage": "double", "first_word": "int", "last_word": "int",
            "licenses": "array<string>"}
    keep = without(docs, list(made))
    source = docs.select(*keep) if text in keep else docs.select(*keep, text)
    known = [(name, words_of(t)) for name, t in templates.items()]
    known = [(name, w, Counter(w)) for name, w in known if w]
    every = frozenset(w for _, w, _ in known for w in w)

    def judge(value: str | None):
        words = words_of(value) if value else []
        held = Counter(w for w in words if w in every)
        hits = []
        for name, template, parts in known:
            if sum(min(n, held[w]) for w, n in parts.items()) < least * len(template):
                continue
            coverage, first, last = best_coverage(words, template)
            if coverage >= least:
                hits.append((-coverage, -len(template), name, first, last))
        if not hits:
            return None, 0.0, None, None, []
        hits.sort()
        return hits[0][2], -hits[0][0], hits[0][3], hits[0][4], [h[2] for h in hits]

    def run(batches):
        kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
        for batch in bounded_batches(batches):
            rows = [judge(v) for v in
                    batch.column(batch.schema.get_field_index(text)).to_pylist()]
            columns = zip(*rows) if rows else [[]] * len(made)
            yield append(batch, keep, {name: pa.array(list(c), kind) for name, kind, c
                                       in zip(made, kinds, columns)})

    return source.mapInArrow(run, schema_of(source, keep,
                                            ", ".join(f"{k} {v}" for k, v in made.items())))
