"""License scans: sparse TF-IDF cosine of sentences to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, settle, tidy, utf8
from .shingles import word_hashes, word_spans

#: Cosine from which a sentence is a template's, and a whole text a licence file's; share of a text's words that makes it a licence file.
ALIKE, WHOLE, MOSTLY = 0.6, 0.75, 0.5
#: Directories up to which what they inherit is broadcast (some 200 bytes each); beyond, both sides are dealt in so many parts a directory.
DIRECTORIES, WAYS = 100_000, 32
#: Slots of the document frequencies (their size does not depend on the corpus).
SLOTS = 1 << 18
#: Names of licence files.
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([._-][^/]*)?$"

# Sentences by which widely used licences are declared.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)

# Whole texts of licences that stand in files of their own, as published.
FILES = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
)

_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(33, 48)] + [b for b in range(58, 65)] + [b for b in range(91, 97)] + [b for b in range(123, 127)]] = True


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and sentence of every word, and the sentences before each text (n + 1 offsets).

    Marks count as blanks, but for points and hyphens inside a word; a line break, or one
    of .!? with a blank after it, ends a sentence.
    """
    n = len(data)
    blank_after = np.ones(n, bool)
    if n:
        blank_after[:-1] = (data[1:] <= 32) & (data[1:] != 0)
    at_end = np.zeros(n, bool)
    if n:
        full = offs[1:][offs[1:] > offs[:-1]]
        at_end[full - 1] = True
    inner = ((data == 46) | (data == 45)) & ~blank_after & ~at_end
    bare = np.where(_MARKS[data] & ~inner, np.uint8(32), data)
    stop = (data == 10) | (((data == 46) | (data == 33) | (data == 63)) & (blank_after | at_end))
    starts, ends, at = word_spans(bare, offs)
    # A word's sentence: the stops before it, and the texts before it.
    stops = np.cumsum(stop)
    text_of = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    key = (stops[starts] if len(starts) else np.empty(0, np.int64)) + text_of
    sentence = np.cumsum(np.concatenate([[0], (np.diff(key) > 0).astype(np.int64)])) if len(key) else key
    counts = np.bincount(text_of, minlength=len(offs) - 1)
    sent_at = np.zeros(len(offs), np.int64)
    total = int(sentence[-1]) + 1 if len(sentence) else 0
    ends_at = np.concatenate([[0], np.cumsum(counts)])
    sent_at[:] = [int(sentence[i]) if i < len(sentence) else total for i in ends_at.tolist()]
    return word_hashes(bare, starts, ends), sentence, sent_at


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each slot's words occur, over all texts, and the number of texts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offs = utf8(part.column(0))
                h, sentence, sent_at = _terms(data, offs)
                owner = np.searchsorted(sent_at, sentence, "right") - 1
                key = np.unique(owner * SLOTS + (h % np.uint64(SLOTS)).astype(np.int64))
                total += np.bincount(key % SLOTS, minlength=SLOTS)
                texts += part.num_rows
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *slot.tolist()], pa.int32()), pa.array([texts, *total[slot].tolist()], pa.int64())], names=["slot", "n"])

    got = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = got["slot"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(SLOTS, np.int64)
    out[slot[slot >= 0]] = n[slot >= 0]
    return out, int(n[slot < 0].sum())


class Matcher:
    """Sentences against headers' templates, and whole texts against licence files, by TF-IDF cosine."""

    def __init__(self, df: np.ndarray, texts: int, templates: tuple[tuple[str, str], ...] = TEMPLATES, files: tuple[tuple[str, str], ...] = FILES):
        self.files = Matcher(df, texts, files, ()) if files else None
        self.idf = np.log((1.0 + texts) / (1.0 + df)) + 1.0
        self.names = [name for name, _ in templates]
        raw = [t.encode() for _, t in templates]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        h, sentence, sent_at = _terms(data, offs)
        owner = np.searchsorted(sent_at, sentence, "right") - 1
        self.vocabulary = np.unique(h)
        self.weight = np.zeros((len(self.vocabulary), len(templates)))
        for t in range(len(templates)):
            terms, tf = np.unique(h[owner == t], return_counts=True)
            w = tf * self.weigh(terms)
            self.weight[np.searchsorted(self.vocabulary, terms), t] = w / math.sqrt((w**2).sum())

    def weigh(self, h: np.ndarray) -> np.ndarray:
        return self.idf[(h % np.uint64(SLOTS)).astype(np.int64)]

    def whole(self, h: np.ndarray, owner: np.ndarray, texts: int) -> dict[int, tuple[str, float]]:
        """The texts (words h of texts `owner`) that are as a whole like one of this matcher's, wherever their lines break."""
        near = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[near] == h
        w = self.weigh(h)
        # Exact over the templates' words; other words' repeats count for themselves, so the norm is no larger than it is.
        size = len(self.vocabulary)
        rest = np.bincount(owner[~known], w[~known] ** 2, texts)
        full = np.flatnonzero(np.bincount(owner[known], minlength=texts) >= 20)
        out = {}
        for lo in range(0, len(full), 256):
            some = full[lo : lo + 256]
            place = np.full(texts, -1)
            place[some] = np.arange(len(some))
            mine = np.flatnonzero(known & (place[owner] >= 0))
            tf = np.bincount(place[owner[mine]] * size + near[mine], minlength=len(some) * size).reshape(-1, size)
            x = tf * self.weigh(self.vocabulary)
            dots, inside = x @ self.weight, (x**2).sum(1)
            for i in np.flatnonzero(dots.max(1) >= WHOLE * np.sqrt(inside + rest[some])).tolist():
                terms, n = np.unique(h[(owner == some[i]) & ~known], return_counts=True)
                cosine = dots[i].max() / math.sqrt(inside[i] + ((n * self.weigh(terms)) ** 2).sum())
                if cosine >= WHOLE:
                    out[int(some[i])] = (self.names[int(np.argmax(dots[i]))], float(cosine))
        return out

    def scan(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[str | None, float, float]]:
        """Per text: its licence, the cosine, and the share of its words that state it.

        A text that is as a whole a licence file has that licence and a share of 1; another
        that of its most alike sentence, and the share of its words in such sentences.
        """
        h, sentence, sent_at = _terms(data, offs)
        n_sent = int(sent_at[-1])
        out: list[tuple[str | None, float, float]] = [(None, 0.0, 0.0)] * (len(offs) - 1)
        if not n_sent:
            return out
        files = self.files.whole(h, np.searchsorted(sent_at, sentence, "right") - 1, len(out)) if self.files else {}
        near = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[near] == h)
        w = self.weigh(h)
        # cosine ** 2 <= (sum of matched weights) ** 2 / (sum of all squares), with every repeat counted for itself.
        square = np.bincount(sentence, w * w, minlength=n_sent)
        told = np.bincount(sentence[hit], w[hit], minlength=n_sent)
        maybe = np.flatnonzero(told * told >= ALIKE * ALIKE * square)
        first = np.searchsorted(sentence, np.arange(n_sent + 1))
        best: dict[int, tuple[float, str, int]] = {}
        size = np.diff(first)
        for s in maybe.tolist():
            terms, tf = np.unique(h[first[s] : first[s + 1]], return_counts=True)
            weight = tf * self.weigh(terms)
            at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
            ok = self.vocabulary[at] == terms
            cosine = (weight[ok] @ self.weight[at[ok]]) / math.sqrt((weight**2).sum())
            t = int(np.argmax(cosine))
            if cosine[t] >= ALIKE:
                best[s] = (float(cosine[t]), self.names[t], int(size[s]))
        owner = np.searchsorted(sent_at, np.array(sorted(best)), "right") - 1 if best else []
        words = np.diff(first[sent_at])
        for s, d in zip(sorted(best), owner):
            c, name, k = best[s]
            had = out[d]
            share = had[2] + k / max(1, int(words[d]))
            out[d] = (name, c, share) if had[0] is None or c > had[1] else (had[0], had[1], share)
        for d, (name, c) in files.items():
            out[d] = (name, c, 1.0)
        return out


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(df: DataFrame, path: Column, text: str = "text") -> DataFrame:
    """df with license, cosine, license_share, inherited_license, inherited_from (a directory) and effective_license.

    Whole texts are read, sentence by sentence and as a whole, very long ones too. A licence
    file is one so named, or a text that is mostly licence; the files of a directory stand
    for all below it, the nearest first (of several files in one directory that of the
    highest cosine, then the least name). A text's own licence comes before an inherited
    one. Null or empty texts have none; a null path has no directory and inherits nothing;
    rows repeat; an empty table gives none. Columns of df named like a result are replaced,
    others may have any name.
    """
    out = ("license", "cosine", "license_share", "inherited_license", "inherited_from", "effective_license")
    held = [F.col(f"`{c}`") for c in df.columns if c not in out]
    matcher = Matcher(*document_frequencies(df, text))

    @F.arrow_udf("license string, cosine double, license_share double")
    def told(texts: pa.Array) -> pa.Array:
        found = [x for part in pieces(pa.RecordBatch.from_arrays([texts.fill_null("")], names=["text"])) for x in matcher.scan(*utf8(part.column(0)))]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))], names=["license", "cosine", "license_share"])

    rows = df.select(F.struct(*held).alias("row"), path.cast("string").alias("path"), told(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("told"))
    found = settle(rows.withColumn("dir", directory(F.col("path"))), "licenses")
    files = found.filter(F.col("told.license").isNotNull() & F.col("path").isNotNull() & (F.col("path").rlike(FILE_NAME) | (F.col("told.license_share") >= MOSTLY)))
    by_dir = files.groupBy(F.col("dir").alias("at")).agg(F.min(F.struct((-F.col("told.cosine")).alias("c"), F.col("told.license").alias("l"))).alias("m")).select("at", F.col("m.l").alias("l"))
    # Every directory once, with its ancestors: hot directories do not multiply.
    dirs = found.filter(F.col("path").isNotNull()).select("dir").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))))).alias("up")).distinct()
    near = above.join(by_dir, above["up"] == by_dir["at"]).groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "up", "l")).alias("m")).select(F.col("dir").alias("d"), F.col("m.l").alias("inherited_license"), F.col("m.up").alias("inherited_from"))
    near = settle(near, "near")
    if near.count() <= DIRECTORIES:
        everything = found.join(F.broadcast(near), found["dir"] == near["d"], "left")
    else:  # a directory with very many files is dealt over several tasks
        spread = near.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
        everything = found.withColumn("way", F.pmod(F.xxhash64("path"), F.lit(WAYS))).join(spread, (F.col("dir") == F.col("d")) & (F.col("way") == F.col("w")), "left")
    return everything.select(
        F.col("row"), "told", *[F.when(F.col("path").isNotNull(), F.col(c)).alias(c) for c in ("inherited_license", "inherited_from")],
    ).select("row.*", "told.license", "told.cosine", "told.license_share", "inherited_license", "inherited_from", F.coalesce("told.license", "inherited_license").alias("effective_license"))
