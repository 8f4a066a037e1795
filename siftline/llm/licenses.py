"""License scans: MinHash bands over overlapping text windows, verified by exact shingle containment.

Words are [0-9a-z and non-ASCII]+ of the lower-cased (A-Z) text; shingles are five
words.  A template of n shingles belongs to the class whose windows hold 1.5 times the
class's largest n, and start every third of that n, so that some window holds any
occurrence whole.  A window that contains the share MATCH of a template has a Jaccard
similarity of at least MATCH / (WIDER + 1 - MATCH) with it in its class (WIDER: window
size over template size), and BANDS bands of ROWS hashes retrieve the template with the
probability that `collision` states; a retrieved template is then verified by counting.
Windows without any template shingle cannot share a minimum with a template, and are
not hashed.

A template matches a document if some window contains at least MATCH of its distinct
shingles.  Templates are a fixed, small table.  Null and empty texts match nothing;
document rows are answered one by one, repeated ids included; null ids stay null.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, column, id_of, keyed, table
from .decontamination import _FOLD
from .textops import Words, mix, ngrams

SHINGLE = 5
MATCH = 0.8
GROWTH = 1.5
WINDOW = 1.5
BANDS = 48
ROWS = 2
# Notices by which public licenses are applied.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_TABLE = np.frombuffer(_FOLD, np.uint8)


def collision(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The probability that two sets of that Jaccard similarity agree on a band."""
    return 1 - (1 - similarity**rows) ** bands


def _shingles(texts):
    words = Words(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, fold=_TABLE)
    grams = ngrams(words.hash, SHINGLE)
    whole = words.row[: len(grams)] == words.row[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    return words, grams, whole


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minhashes(sets: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """MinHash signatures of the rows of a matrix of hashes."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    for k, seed in enumerate(_seeds(BANDS * ROWS)):
        h = mix(sets * seed)
        h[~valid] = np.uint64((1 << 64) - 1)
        out[:, k] = h.min(1)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]) * np.uint64(0xD6E8FEB86659FD93)
    for r in range(ROWS):
        out = mix(out + parts[:, :, r])
    return out


class Index:
    """The templates' shingles and bands, by window class."""

    def __init__(self, templates: dict):
        self.names = sorted(templates)
        self.sets = []
        for name in self.names:
            _, grams, whole = _shingles([templates[name]])
            self.sets.append(np.unique(grams[whole]))
            if not len(self.sets[-1]):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        self.known = np.unique(np.concatenate(self.sets))
        self.classes = {}
        for t, own in enumerate(self.sets):
            top = 1
            while top < len(own):
                top = max(top + 1, int(top * GROWTH))
            self.classes.setdefault(top, []).append(t)
        self.tables = {}
        for top, members in self.classes.items():
            found = self.tables[top] = {}
            for t in members:
                own = self.sets[t][None, :]
                for b in bands(minhashes(own, np.ones(own.shape, bool)))[0].tolist():
                    found.setdefault(b, []).append(t)

    def has(self, grams: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return self.known[at] == grams

    def matches(self, texts, least: float = MATCH) -> dict:
        """(row, template) -> (containment, first word of the window)."""
        words, grams, whole = _shingles(texts)
        best = {}
        if not len(grams):
            return best
        hits = np.flatnonzero(whole)
        hits = hits[self.has(grams[hits])]
        if not len(hits):
            return best
        row = words.row[hits]
        head = words.first[row]
        last = words.first[row + 1] - SHINGLE  # the row's last shingle
        for top, found in self.tables.items():
            size, stride = max(1, int(np.ceil(top * WINDOW))), max(1, top // 3)
            step = (hits - head) // stride
            back = (size - 1) // stride
            starts = np.concatenate([head + np.maximum(step - k, 0) * stride for k in range(back + 1)])
            keep = starts + size > np.tile(hits, back + 1)
            starts, at = np.unique(starts[keep], return_index=True)
            rows, ends = np.tile(row, back + 1)[keep][at], np.tile(last, back + 1)[keep][at]
            for lo in range(0, len(starts), 4096):
                where = starts[lo : lo + 4096, None] + np.arange(size)[None, :]
                valid = where <= ends[lo : lo + 4096, None]
                sets = grams[np.minimum(where, len(grams) - 1)]
                for i, window in enumerate(bands(minhashes(sets, valid)).tolist()):
                    candidates = {t for b in window if b in found for t in found[b]}
                    if candidates:
                        own = sets[i][valid[i]]
                        for t in candidates:
                            share = np.isin(self.sets[t], own).mean()
                            key, start = (int(rows[lo + i]), t), int(starts[lo + i] - words.first[rows[lo + i]])
                            if share >= least and (key not in best or (share, -start) > (best[key][0], -best[key][1])):
                                best[key] = (float(share), start)
        return best


def _scan(templates: dict, least: float):
    def run(batches):
        index = Index(templates)
        for batch in chunked(batches):
            found = [[] for _ in range(batch.num_rows)]
            for (row, t), (share, start) in sorted(index.matches(column(batch, "text"), least).items()):
                found[row].append({"license": index.names[t], "containment": share, "first_word": start})
            kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64())]))
            yield pa.RecordBatch.from_arrays([column(batch, "_k"), pa.array(found, kind)], ["_k", "matches"])

    return run


def scanned(docs: DataFrame, templates: dict | None = None, least: float = MATCH) -> DataFrame:
    """doc_id and its matches (license, containment, first word of the window), by license, for every row of docs."""
    rows = keyed(docs).select("_k", "text").mapInArrow(
        _scan(templates or TEMPLATES, least), "_k long, matches array<struct<license:string,containment:double,first_word:long>>")
    return rows.select(id_of().alias("doc_id"), "matches")


def query(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("matches").cast("long").alias("n_licenses"),
        F.array_join(F.transform("matches", lambda m: m["license"]), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)), 6).alias("best_containment"))
