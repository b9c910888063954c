"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies."""

from __future__ import annotations

import pkgutil
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash as th
from .tables import small_batches

# Public notices by which licences are declared.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved. Unauthorized copying of this file is strictly prohibited.",
}

# Further notices; whole texts come from licence_texts.
NOTICES = {
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause-notice": "Released under the BSD 2-Clause License.",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT-licensed": "Licensed under the MIT License.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
}
TEXTS = [
    "0BSD", "Apache-2.0", "Artistic", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GFDL-1.3", "GPL-2", "GPL-3", "ISC", "LGPL-2.1",
    "LGPL-3", "MIT", "MPL-2.0", "Unlicense",
]


@cache
def all_templates() -> dict[str, str]:
    """Notices and whole texts (name-text), read on the driver."""
    whole = {f"{n}-text": pkgutil.get_data(__package__, f"licence_texts/{n}.txt").decode() for n in TEXTS}
    return TEMPLATES | NOTICES | whole


U = np.uint64
#: Hash functions of a window's MinHash, one band each. A window holds at least a quarter of its
#: shingles in common with a template that it contains to 3/4, so it is missed with
#: probability (3/4)**96 = 1e-12 at most.
HASHES = 96
#: Containment of a template's shingles that counts, in percent.
PERCENT = 75

_SALT = th.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def _minhash(shingles: np.ndarray) -> np.ndarray:
    return th.mix(shingles[:, None] ^ _SALT[None, :]).min(axis=0)


def _template_index(templates: dict[str, str]) -> list[dict]:
    """Templates by length class: window length, stride, band tables, shingle sets."""
    classes: dict[int, dict] = {}
    for name, text in sorted(templates.items()):
        words, counts = th.word_hashes(*th.text_bytes(pa.array([text])), punctuation=True)
        shingles = np.unique(th.shingle_hashes(words, counts)[0])
        top = max(5, 1 << int(np.ceil(np.log2(max(len(words), 1)))) if len(words) > 5 else 5)
        c = classes.setdefault(top, {"stride": max(1, top // 2), "window": top + max(1, top // 2), "names": [], "sets": [], "bands": {}})
        for k, v in enumerate(_minhash(shingles)):
            c["bands"].setdefault((k, int(v)), []).append(len(c["names"]))
        c["names"].append(name)
        c["sets"].append(shingles)
    return [c | {"all": np.unique(np.concatenate(c["sets"]))} for _, c in sorted(classes.items())]


def _scan(templates: dict[str, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _template_index(templates)
        known = np.unique(np.concatenate([c["all"] for c in classes]))
        seen = np.zeros(1 << 20, bool)
        seen[(known >> U(44)).astype(np.int64)] = True
        for batch in batches:
            docs, names, places, shares = [], [], [], []
            data, offsets = th.text_bytes(batch.column(1))
            ids = batch.column(0)
            for i, j in th.slices(offsets):
                words, counts = th.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], punctuation=True)
                shingles, per = th.shingle_hashes(words, counts)
                # only a window with a shingle of some template can share a least hash with one
                at = np.flatnonzero(seen[(shingles >> U(44)).astype(np.int64)])
                at = at[known[np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)] == shingles[at]]
                if not len(at):
                    continue
                ends = np.cumsum(per)
                for doc in np.unique(np.searchsorted(ends, at, "right")):
                    a, b = int(ends[doc] - per[doc]), int(ends[doc])
                    mine = at[(at >= a) & (at < b)] - a
                    for name, (share, place) in _windows(shingles[a:b], mine, classes).items():
                        docs.append(i + doc)
                        names.append(name)
                        places.append(place)
                        shares.append(share)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(docs, pa.int64())), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(places, pa.int64())],
                ["doc_id", "license", "containment", "first_word"],
            )

    return run


def _related(a: np.ndarray, b: np.ndarray) -> bool:
    """Templates that have half of the smaller one's shingles in common."""
    return 2 * len(np.intersect1d(a, b)) >= min(len(a), len(b))


def _windows(shingles: np.ndarray, hits: np.ndarray, classes: list[dict]) -> dict[str, tuple[float, int]]:
    """Best (containment, first word of the window) of every template found in one text. Where two
    related templates are found in one place, the better contained or else the longer one counts."""
    finds = []
    for c in classes:
        span = max(1, c["window"] - 4)
        mine = hits[np.isin(shingles[hits], c["all"])]
        starts = set()
        for h in mine:
            low = max(0, -(-(int(h) - span + 1) // c["stride"]))
            starts.update(range(low * c["stride"], int(h) + 1, c["stride"]))
        for s in sorted(starts):
            window = shingles[s : s + span]
            found = {t for k, v in enumerate(_minhash(window)) for t in c["bands"].get((k, int(v)), ())}
            for t in sorted(found):
                inside = int(np.isin(c["sets"][t], window).sum())
                if 100 * inside >= PERCENT * len(c["sets"][t]):
                    at = s + np.flatnonzero(np.isin(window, c["sets"][t]))
                    finds.append((inside / len(c["sets"][t]), len(c["sets"][t]), c["names"][t], s, int(at[0]), int(at[-1]) + 1, c["sets"][t]))
    best: dict[str, tuple[float, int]] = {}
    kept: list[tuple] = []
    for share, size, name, s, first, end, own in sorted(finds, key=lambda f: (-f[0], -f[1], f[2], f[3])):
        beaten = any(
            n != name and 2 * (min(end, e) - max(first, f)) > min(end - first, e - f) and _related(own, other) for n, f, e, other in kept
        )
        if not beaten:
            kept.append((name, first, end, own))
            best.setdefault(name, (round(share, 6), s))
    return best


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word): every template of which some window of a document
    holds at least PERCENT of the five-word shingles; containment is the best window's, first_word the
    start of the first such window. Words are runs of letters and digits, so that comment markers, wraps
    and punctuation don't count. Where related templates are found in one place (a notice inside a
    whole text, GPL and AGPL), only the best contained or else the longest is reported.

    Windows of 1.5 times the length of a template class every half length hold each occurrence
    whole. Documents without a notice, null and empty texts give no row. Rows are independent:
    repeated rows repeat their finds, a null id stays null. An empty table gives an empty
    result; other columns are ignored. No shuffle.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_scan(templates or all_templates()), f"doc_id {kind}, license string, containment double, first_word long")
