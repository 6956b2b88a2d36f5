"""License statements in documents.

A statement is a set of shingles: runs of five words, or, for statements of a few words, its single
words and the runs of words that name the license. Shingles that no statement has cannot match, so
a text is reduced to those that one has; most texts have none that tells.

For each length of statement a text is cut into windows of twice that length that overlap by half,
so that any copy of a statement lies in one window as a whole. A window with a telling shingle gets a
MinHash signature of 64 bands of one minimum. A window that holds a statement shares a fifth of
the shingles of both at least, so all bands miss such a pair with a probability below 1e-6. What
shares a band is verified by the share of the statement's shingles that the window holds, compared
word by word. Of a short statement all names must be there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewarden.llm.common import ship
from tidewarden.llm.minhash import mix

ship(__name__)

WORDS = 5
BANDS = 64
HOLDS = 0.8
SPELLED = {"licence": "license", "licenced": "licensed"}  # other spellings
SCHEMA = "doc_id bigint, n_licenses bigint, licenses string, spans string"
# Usual statements of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}
# Names of public licences; each stands in the usual statements.
PUBLIC = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License",),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2", "GPL v2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3", "GPL v3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL v3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL v3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0", "EPL 2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
} | {
    f"CC-{kind}-4.0": (f"CC {kind} 4.0", f"CC-{kind} 4.0", f"CC-{kind}-4.0", f"Creative Commons {long} 4.0 International License", f"Creative Commons {long} 4.0 License")
    for kind, long in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    )
}
VERBS = ("Licensed", "Released", "Distributed", "Available", "Published")
WORDINGS = {
    name: [f"{v} under the {x}" for v in VERBS for x in (*names, name)] + [f"{v} under {x}" for v in VERBS for x in (*names, name)] + [f"under the terms of the {x}" for x in names] + [f"SPDX-License-Identifier: {name}"]
    for name, names in PUBLIC.items()
}
WORDINGS["Unlicense"].append("This is free and unencumbered software released into the public domain.")
WORDINGS["ISC"].append("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")
WORDINGS["MPL-2.0"].append("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.")
SHORT = 16  # words of a statement whose shingles are single words and names
# Words of a statement that do not name the license.
PLAIN = set("licensed released distributed available published under the a an license version v terms of this that work works is are file and or later into to in with by".split()) - {"by"}


class Statement:
    """A wording of a license: its shingles with their weights in words, and those that must be there."""

    def __init__(self, name: str, words: list[str]) -> None:
        self.name, self.length = name, 1 << max(0, len(words) - 1).bit_length()
        if len(words) > SHORT:
            self.telling = {tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)}
            self.weights, self.must = dict.fromkeys(self.telling, 1), set()
        else:
            self.telling = {tuple(g) for plain, g in groupby(words, PLAIN.__contains__) if not plain}
            single = {(w,) for w in words if w in PLAIN}
            self.weights, self.must = dict.fromkeys(single, 1) | {s: len(s) for s in self.telling}, self.telling
        self.total = sum(self.weights.values())


class Scanner:
    def __init__(self, templates: dict[str, str], wordings: dict[str, list[str]] | None = None) -> None:
        self.word = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
        every = [(n, t) for n, t in templates.items()] + [(n, t) for n, ts in (wordings or {}).items() for t in ts]
        self.statements = [x for x in (Statement(n, self.words(t)) for n, t in every) if x.telling]
        self.by_length: dict[int, list[Statement]] = {}
        for x in self.statements:
            self.by_length.setdefault(x.length, []).append(x)
        shingles = sorted({s for x in self.statements for s in x.weights})
        number = {s: i for i, s in enumerate(shingles)}
        seeds = np.random.default_rng(11).integers(1, 1 << 63, BANDS, np.uint64)
        values = mix(np.arange(1, len(shingles) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.bands = np.stack([mix(values ^ s) for s in seeds], 1) if shingles else np.zeros((0, BANDS), np.uint64)
        for x in self.statements:
            x.weight_of, x.names = {number[s]: w for s, w in x.weights.items()}, {number[s] for s in x.must}
        self.signed = {length: np.stack([self.bands[list(x.weight_of)].min(0) for x in xs]) for length, xs in self.by_length.items()}
        # Telling shingles by their first word; single words that tell nothing by themselves.
        self.tells: dict[str, list[tuple[tuple[str, ...], int]]] = {}
        for s in {s for x in self.statements for s in x.telling}:
            self.tells.setdefault(s[0], []).append((s, number[s]))
        self.single = {s[0]: i for s, i in number.items() if len(s) == 1 and s[0] in PLAIN}

    def words(self, text: str) -> list[str]:
        words = list(map(str.lower, self.word.findall(text)))
        return words if SPELLED.keys().isdisjoint(words) else [SPELLED.get(w, w) for w in words]

    def telling(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(first word, words, shingle) of each telling shingle of the text."""
        found, first = [], self.tells.keys() & words
        for at, word in enumerate(words) if first else ():
            if word in first:
                for shingle, i in self.tells[word]:
                    if len(shingle) == 1 or tuple(words[at : at + len(shingle)]) == shingle:
                        found.append((at, len(shingle), i))
        return found

    def stretches(self, x: Statement, events: list[tuple[int, int, int]]) -> Iterator[tuple[float, int, int]]:
        """(share, first word, end) of the shortest stretches of the window that hold the statement
        as well as any, one after the other without overlap."""
        mine = [e for e in events if e[2] in x.weight_of]
        while True:
            present = {e[2] for e in mine}
            held = sum(x.weight_of[i] for i in present)
            if held < HOLDS * x.total or not x.names <= present:
                return
            counts: dict[int, int] = {}
            inside, left, best = 0, 0, None
            for at, n, i in mine:
                counts[i] = counts.get(i, 0) + 1
                inside += x.weight_of[i] if counts[i] == 1 else 0
                while inside == held:
                    low = mine[left]
                    if best is None or at + n - low[0] < best[1] - best[0]:
                        best = (low[0], at + n)
                    counts[low[2]] -= 1
                    inside -= 0 if counts[low[2]] else x.weight_of[low[2]]
                    left += 1
            yield held / x.total, *best
            mine = [e for e in mine if e[0] >= best[1] or e[0] + e[1] <= best[0]]

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(license, start, end) of the words that hold it, by start; ends are exclusive. Spans of
        one license do not overlap; of those that would the best held and largest statement stays."""
        words = self.words(text)
        telling = self.telling(words)
        if not telling:
            return []
        found = []
        singles = [(at, 1, self.single[w]) for at, w in enumerate(words) if w in self.single]
        places_of_singles = [e[0] for e in singles]
        for length, statements in self.by_length.items():
            windows: dict[int, list[tuple[int, int, int]]] = {}
            for event in telling:
                start = event[0] // length * length
                windows.setdefault(start, []).append(event)
                if start:
                    windows.setdefault(start - length, []).append(event)
            for start, events in windows.items():
                near = slice(bisect_left(places_of_singles, start), bisect_left(places_of_singles, start + 2 * length))
                held = sorted(events + singles[near])
                band = self.bands[list({e[2] for e in held})].min(0)
                for i in np.flatnonzero((self.signed[length] == band).any(1)).tolist():
                    x = statements[i]
                    found += [(-share, -x.total, end - first, first, end, x.name) for share, first, end in self.stretches(x, held)]
        places, kept = [m.span() for m in self.word.finditer(text)], {}
        for *_, first, end, name in sorted(set(found)):
            spans = kept.setdefault(name, [])
            if all(end <= a or first >= b for a, b in spans):
                spans.append((first, end))
        return sorted(((n, places[a][0], places[b - 1][1]) for n, spans in kept.items() for a, b in spans), key=lambda f: (f[1], f[2], f[0]))


def find_licenses(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_licenses, the names found (sorted) and name:start:end spans.

    Null and empty texts hold none. Repeated rows give repeated rows, an empty table none; other
    columns are not read. Case and punctuation do not count.
    """
    wordings = WORDINGS if templates is None else None
    templates = TEMPLATES if templates is None else templates

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, wordings)
        for batch in batches:
            found = [scanner.scan(t or "") for t in batch["text"]]
            names = [sorted({n for n, _, _ in f}) for f in found]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "n_licenses": [len(n) for n in names],
                    "licenses": [",".join(n) for n in names],
                    "spans": [",".join(f"{n}:{a}:{b}" for n, a, b in f) for f in found],
                }
            )

    return documents.select("doc_id", "text").mapInPandas(work, SCHEMA)
