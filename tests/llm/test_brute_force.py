"""Operators without SQL, computed again the slow way."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ctw, fingerprints, language_id, licenses, lm_scoring
from tessera.llm.shingles import mix, shingle_hashes


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


class SlowTree:
    """Context-tree weighting by recursion over dictionaries; a context that occurred once has no longer ones below it."""

    def __init__(self, text: bytes, depth: int, starts: list[int]):
        self.depth, self.n, self.seen = depth, defaultdict(lambda: [0, 0]), Counter()
        self.below = defaultdict(set)
        for i in starts:
            for d in range(depth + 1):
                self.seen[text[i - d : i]] += 1
        for i in starts:
            for d in range(depth + 1):
                if d and self.seen[text[i - d + 1 : i]] < 2:
                    break
                for bit in range(8):
                    node = (text[i - d : i], bit, text[i] >> (8 - bit))
                    self.n[node][text[i] >> (7 - bit) & 1] += 1
                    if d:
                        self.below[(text[i - d + 1 : i], bit, text[i] >> (8 - bit))].add(node)
        self.known: dict = {}

    def kt(self, node):
        a, b = self.n[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node):
        if node not in self.known:
            own = self.kt(node)
            kids = sorted(self.below.get(node, ()))
            self.known[node] = own if not kids else np.logaddexp(own, sum(map(self.weighted, kids))) - math.log(2)
        return self.known[node]

    def bit(self, context: bytes, bit: int, prefix: int, value: int) -> float:
        p = 0.5
        for d in range(self.depth, -1, -1):
            node = (context[len(context) - d :], bit, prefix)
            if node in self.n:
                a, b = self.n[node]
                share = math.exp(self.kt(node) - math.log(2) - self.weighted(node)) if self.below.get(node) else 1.0
                one = (b + 0.5) / (a + b + 1)
                p = share * (one if value else 1 - one) + (1 - share) * p
        return p

    def log10(self, text: bytes, starts) -> float:
        return sum(math.log10(self.bit(text[max(0, i - 99) : i], k, text[i] >> (8 - k), text[i] >> (7 - k) & 1)) for i in starts for k in range(8))


def test_lm_scores_by_a_plain_recursion(spark):
    rng = random.Random(4)
    syllables = ["ka", "to", "mi", "re", "na", "so"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 14))) for _ in range(24)]
    flags = [i % 4 == 0 for i in range(24)]
    d = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(zip(texts, flags))], "doc_id long, text string, held_out boolean").repartition(2)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(d, lm_scoring.train(d, ~F.col("held_out"))).collect()}
    pad = lambda t: bytes([ctw.END]) * ctw.DEPTH + t.encode() + bytes([ctw.END])
    joined, starts = b"", []
    for t, f in zip(texts, flags):
        if not f:
            starts += range(len(joined) + ctw.DEPTH, len(joined) + len(pad(t)))
            joined += pad(t)
    tree = SlowTree(joined, lm_scoring.COUNTED, starts)
    for i, t in enumerate(texts):
        want = tree.log10(pad(t), range(ctw.DEPTH, len(pad(t))))
        assert got[i] == pytest.approx(want, rel=2e-3), (i, t)


def test_fingerprint_bytes():
    rng = random.Random(6)
    texts = ["", "one", "a b c d e", *(" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (9, 40, 300, 5000))]
    got = fingerprints.fingerprints(texts)
    bins, bits = fingerprints.BINS, fingerprints.BITS
    for t, mine in zip(texts, got):
        h, _ = shingle_hashes(*packed([t]))
        least: dict[int, int] = {}
        for x in h.tolist():
            b = x >> (64 - (bins.bit_length() - 1))
            least[b] = min(least.get(b, 2**64), x)
        if not least:
            assert mine == b""
            continue
        low = []
        for b in range(bins):
            to = b if b in least else next(x for x in fingerprints._PROBE[b].tolist() if x in least)
            v = int(mix(np.array([(least[to] + b * 0xD1B54A32D192ED03) % 2**64], np.uint64))[0])
            low.append(v & ((1 << bits) - 1))
        assert mine == bytes(low[i] << 4 | low[i + 1] for i in range(0, bins, 2))


def test_license_cosines(spark):
    rng = random.Random(9)
    vocabulary = ["licensed", "under", "the", "apache", "license", "version", "2.0", "tree", "mit", "released", "river", "stone"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 9))) for _ in range(60)] + ["Licensed under the Apache License, Version 2.0.", "released under the mit license now"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["cosine"]) for r in licenses.scan(d, F.lit(None).cast("string")).collect()}
    terms = lambda t: Counter("".join(c if c.isalnum() or c in ".-" else " " for c in t.lower().rstrip(".")).replace(". ", " ").replace(" -", " ").split())
    df = Counter(w for t in texts for w in terms(t))
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w])) + 1
    vector = lambda t: {w: n * idf(w) for w, n in terms(t).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    plain = [(name, vector(t)) for name, t in licenses.TEMPLATES if "\n" not in t]
    found = 0
    for i, t in enumerate(texts):
        v = vector(t)
        best = max((sum(x * u.get(w, 0) for w, x in v.items()) / norm(v) / norm(u), name) for name, u in plain)
        if best[0] >= licenses.ALIKE + 1e-6:
            found += 1
            assert got[i][1] == pytest.approx(best[0], abs=1e-6), t
        elif best[0] < licenses.ALIKE - 1e-6:
            assert got[i] == (None, 0.0), t
    assert found >= 2


def test_whole_license_files(spark):
    """However the lines break, with a notice before; and prose that shares their words is none."""
    rng = random.Random(3)

    def wrapped(t, width):
        w, lines, line = t.split(), [], ""
        for x in w:
            line, lines = (x, [*lines, line]) if len(line) + len(x) > width else (f"{line} {x}".strip(), lines)
        return "\n".join([*lines, line])

    rows = [(f"p{i}/LICENSE.md", f"Copyright (c) 2019 Some One\n\n{wrapped(t, rng.choice([50, 72, 90]))}") for i, (_, t) in enumerate(licenses.FILES)]
    rows += [(f"p{i}/src/deep/er/x.c", "int main") for i in range(len(rows))] + [("q/a", " ".join(rng.choice("the software is provided as a river and of any use".split()) for _ in range(400)))]
    d = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["path"]: r for r in licenses.scan(d, F.col("path")).collect()}
    for i, (name, _) in enumerate(licenses.FILES):
        assert got[f"p{i}/LICENSE.md"]["license"] == name and got[f"p{i}/LICENSE.md"]["license_share"] == 1.0
        assert (got[f"p{i}/src/deep/er/x.c"]["inherited_license"], got[f"p{i}/src/deep/er/x.c"]["inherited_from"]) == (name, f"p{i}")
    assert got["q/a"]["license"] is None


def test_hot_directories_are_dealt(spark, monkeypatch):
    rows = [("a/LICENSE", licenses.FILES[0][1])] + [(f"a/b{i % 2}/{i}", "words") for i in range(200)]
    d = spark.createDataFrame(rows, "path string, text string")
    want = sorted(map(str, licenses.scan(d, F.col("path")).collect()))
    monkeypatch.setattr(licenses, "DIRECTORIES", 0)
    assert sorted(map(str, licenses.scan(d, F.col("path")).collect())) == want


def test_language_posteriors(spark):
    """The fused posterior from trigram tables, by loops over rows."""
    rng = random.Random(12)
    lands = {"aa": ["kolo", "miri", "tass"], "bb": ["dorn", "velt", "kolo"], "cc": ["ouis", "miri", "chat"]}
    texts = [(i, " ".join(rng.choice(lands[k]) for _ in range(rng.randrange(1, 9))), k, rng.choice(["x.de", "y.de", "z.fr", None]), rng.choice(["de", None])) for i, k in enumerate(rng.choice(sorted(lands)) for _ in range(90))]
    texts += [(90, "", "aa", "x.de", None), (91, None, None, None, "de"), (92, "12 34", None, "z.fr", None)]
    d = spark.createDataFrame(texts, "doc_id long, text string, lang string, host string, declared string").repartition(2)
    model = language_id.fit(d)
    suffix = F.substring_index("host", ".", -1)
    got = {r["doc_id"]: r for r in language_id.identify(d, model, declared=F.col("declared"), host=F.col("host"), domain=F.col("host"), suffix=suffix).collect()}
    k = len(model.languages)
    ll, post = {}, {}
    for i, t, *_ in texts:
        slot, _ = language_id._slots(*packed([t or ""]))
        if len(slot):
            ll[i] = model.table[slot].astype(float).sum(0) * min(len(slot), language_id.SATURATE) / len(slot)
            e = np.exp(ll[i] - ll[i].max())
            post[i] = e / e.sum()
    prior = (sum(post.values()) + 1) / (len(post) + k)
    shrink = language_id.SHRINK
    told = lambda i: (texts[i][3], texts[i][3] and texts[i][3].split(".")[-1], texts[i][4])
    total = lambda ok: sum((post[i] for i in post if ok(*told(i))), np.zeros(k))
    smooth = lambda n, up: (n + shrink * up) / (n.sum() + shrink)
    for i, *_ in texts:
        host, end, declared = told(i)
        s = ll.get(i, np.zeros(k)).copy()
        if host:
            up = smooth(total(lambda h, e, d: h == host), smooth(total(lambda h, e, d: e == end), prior))
            n = total(lambda h, e, d: h == host)
            s += np.log((np.maximum(n - post.get(i, 0), 0) + shrink * up) / (max(n.sum() - (i in post), 0) + shrink))
        else:
            s += np.log(prior)
        if declared:
            s += np.log(smooth(total(lambda h, e, d: d == declared), prior) / prior)
        p = np.exp(s - s.max())
        assert got[i]["lang"] == model.languages[int(np.argmax(s))] and got[i]["confidence"] == pytest.approx(1 / p.sum(), rel=1e-6)
        assert got[i]["text_lang"] == (model.languages[int(np.argmax(ll[i]))] if i in ll else None)
