"""The text operators against brute force, round trips and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import archives, content_store, ctw, decontamination, fingerprints, language_id, licenses, lm_scoring, mixing, ngram_join, queries, token_counts
from tessera.llm.common import settle
from tessera.llm.encoding import encoder

WORD, BENCH_WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKENIZER = queries.tokenizer_path()
ODD = ["", None, " \n\t ", "One", "é É ß", "a b c d e", "A B  c\nd E", "x" * 5000, "the cat sat on the mat and " * 60]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', ',', '.'])}" for _ in range(n))


def docs_of(spark, texts, **extra):
    """doc_id, text and columns whose names clash with results; over several partitions."""
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "en", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens int").repartition(3)


def shingles(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    base = [prose(rng, rng.choice([3, 8, 40, 120])) for _ in range(40)]
    passage = prose(rng, 55)
    texts = [*ODD, *base, *base[:5], *(f"{prose(rng, 60)} {passage} {prose(rng, 60)}" for _ in range(25))]
    hub = prose(rng, 120).split()
    for _ in range(45):  # a group of near copies of all degrees
        w = list(hub)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts


def test_ngram_join_against_all_pairs(spark, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(docs_of(spark, corpus)).collect()}
    sets, up = [shingles(t) for t in corpus], list(range(len(corpus)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and 100 * o >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert len(set(x for _, x in got.values())) < len(corpus) - 20
    assert ngram_join.near_groups(docs_of(spark, corpus).limit(0)).count() == 0
    assert ngram_join.near_groups(spark.createDataFrame([(None, "a b"), (None, None), (3, "a b")], "doc_id long, text string")).count() == 3


def test_prefix_lengths_trade_cost():
    assert ngram_join.prefix_length(100, 80, np.zeros(100, np.uint8)) == 1
    rank = np.zeros(100, np.uint8)
    rank[15:] = 40  # lists of 1024 in the prefix: more shared shingles are asked for
    assert ngram_join.prefix_length(100, 80, rank) > 1
    assert int(ngram_join.needed(5, 80)) == 4 and int(ngram_join.needed_pair(9, 9, 80)) == 8


def test_arc_to_warc_round_trip(spark, tmp_path):
    big = "<html>" + "x" * 1200
    rows = [(1, "http://a/ b", big), (5, "http://b", big), (3, None, big), (2, "http://c", "é" * 3), (4, "http://d", "é" * 3), (6, "http://e", None), (None, "http://f", "WARC/1.1\r\n\r\nx"), (5, "http://b", big)]
    path = f"file://{tmp_path}/w"
    archives.write_arc(archives.to_arc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), f"file://{tmp_path}/arc")
    legacy = archives.read_arc(spark, f"file://{tmp_path}/arc")
    archives.write_warc(archives.to_warc(legacy), path)
    got = sorted(((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in archives.read_warc(spark, path).collect()))
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert [g[:4] for g in got] == [(-1, "response", None, 13), (1, "revisit", 5, 1206), (2, "response", None, 6), (3, "revisit", 5, 1206), (4, "response", None, 6), (5, "response", None, 1206), (5, "revisit", 5, 1206), (6, "response", None, 0)]
    assert {g[4] for g in got} == {sha(big), sha("ééé"), sha(None), sha(rows[6][2])}
    # Every record is a gzip member of its own, and identifiers do not depend on where the files lie.
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    whole = [r for f in files for r in archives.warc_records(f)]
    assert len(whole) == 9 and sum(f.count(b"\x1f\x8b\x08\x00") for f in files) >= 18
    again = {h["warc-record-id"] for r in archives.to_warc(legacy).collect() for h, _ in archives.warc_records(archives.record_bytes(r["header"], bytes(r["head"]), r["body"] and bytes(r["body"])))}
    assert again == {h["warc-record-id"] for h, _ in whole} and len(again) == 9
    assert {h["warc-refers-to"] for h, _ in whole if h["warc-type"] == "revisit"} <= again
    none = spark.createDataFrame([], "page_id long, url string, html string")
    archives.write_arc(archives.to_arc(none), f"file://{tmp_path}/none")
    archives.write_warc(archives.to_warc(archives.read_arc(spark, f"file://{tmp_path}/none")), f"file://{tmp_path}/none2")
    assert archives.read_warc(spark, f"file://{tmp_path}/none2").count() == 0


def test_arc_versions_and_damage():
    one = b"filedesc://x.arc 0.0.0.0 20000101000000 text/plain 77\n1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n" + b"\n" * 14
    block = one[one.index(b"\n") + 1 :]
    one = one.replace(b" 77\n", b" %d\n" % len(block), 1)
    body = b"HTTP/1.0 200 OK\r\n\r\nhello\nworld"
    one += b"\nhttp://a/ 1.2.3.4 20000102030405 text/html; charset=x %d\n" % len(body) + body + b"\nbroken line here\nhttp://b/ 1.2.3.4 20000102030405 image/png 3\nPNG\n"
    got = list(archives.arc_records(one))
    assert [(h["url"], b) for _, h, b in got[1:]] == [("http://a/", body), ("http://b/", b"PNG")] and got[1][1]["mime"] == "text/html; charset=x"


def test_weighted_mix(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "B", "c", None]), rng.choice([0, 1, 5, 9, 40])) for i in range(900)] + [(5, "a", 7), (5, "a", 7), (None, "c", 3)]
    d = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix(d, "size").collect()
    again = mixing.mix(d.repartition(5), "size").collect()
    key = lambda rs: sorted(tuple(-1 if v is None else v for v in (r["doc_id"], r["size"], r["taken"], r["target"])) for r in rs)
    assert key(out) == key(again) and len(out) == len(rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    for r in out:
        x = by[r["source"]]
        x[0] += r["size"]
        x[1] += r["taken"]
        x[2], x[3] = r["target"], r["source_size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(x[0] for x in by.values())
    assert sum(x[2] for x in by.values()) == pytest.approx(1.5 * total) and sum(x[1] for x in by.values()) <= 1.5 * total
    w = dict(zip(sorted((s for s in by if s is not None)) + [None], (5, 2, 1, 5)))
    open_ = [s for s in by if by[s][2] < 2 * by[s][3] - 1e-6]
    for s, x in by.items():
        assert x[0] == x[3] and abs(x[1] - x[2]) <= 40 and x[2] <= 2 * x[0] + 1e-6
    assert len({round(by[s][2] / w[s], 6) for s in open_}) <= 1
    assert mixing.mix(d.limit(0), "size").count() == 0


def test_token_counts_and_store(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    texts = [*corpus[:60], "a<|endoftext|> b", "  double  blanks \n\n x.", "it's 5,000.", "日本 語　x", None]
    want = [x.ids for x in Tokenizer.from_file(TOKENIZER).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    d = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(d, TOKENIZER).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == list(map(len, want))
    assert all(got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (len(want[i]) > 1024) for i, t in enumerate(texts))
    path = f"file://{tmp_path}/ids"
    content_store.write_store(d, TOKENIZER, path)
    index = sorted(map(tuple, content_store.read_index(spark, path).collect()))
    start, rows = 0, []
    for i, ids in enumerate(want):
        ids = [*ids, 2]
        rows.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert index == rows
    assert {r["doc_id"]: r["ids"] for r in content_store.read_ids(spark, path).collect()} == {i: [*x, 2] for i, x in enumerate(want)}
    chunks = content_store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("hash").distinct().count()


def test_damaged_store_is_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    content_store.write_store(docs_of(spark, ["some words here", "and more"]), TOKENIZER, path)
    for name, bad in (("chunks", lambda d: d.withColumn("ids", F.when(F.col("hash").isNotNull(), F.expr("unhex('0100')")))), ("recipes", lambda d: d.filter("doc_id = 0")), ("manifest", lambda d: d.withColumn("root", F.expr("unhex('00')")))):
        for t in ("chunks", "recipes", "manifest"):
            table = spark.read.parquet(f"{path}/{t}")
            (bad(table) if t == name else table).write.parquet(f"file://{tmp_path}/{name}/{t}")
    for name in ("recipes", "manifest"):
        with pytest.raises(ValueError, match="does not match what lies below"):
            content_store.read_index(spark, f"file://{tmp_path}/{name}").collect()
    with pytest.raises(Exception, match="does not match its address"):
        content_store.read_index(spark, f"file://{tmp_path}/chunks").collect()


def test_encoder_cuts_nowhere_wrong():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    parts = ["a", "I'll", "é", "\n", " ", "  ", "\t", " ", "　", "\x1c", ".", ",", "...", "<|endoftext|>", "<|endof", "12", "中", "🙂", "\r\n", "'s", "The ", "Word. ", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    ids, offs = encoder(TOKENIZER).encode(pa.array(texts))
    want = [x.ids for x in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == want


def test_crc_parts_make_the_whole():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 256, n, np.uint8).tobytes() for n in (0, 1, 5, 4096, 70000)]
    after = np.cumsum([0] + [len(p) for p in parts[::-1]])[:-1][::-1]
    got = np.bitwise_xor.reduce(content_store.shift_crc(np.array([zlib.crc32(p) for p in parts]), np.array(after)))
    assert int(got) == zlib.crc32(b"".join(parts))


def test_fingerprints(spark, corpus):
    rows = sorted(fingerprints.compare_with_next(docs_of(spark, corpus)).collect(), key=lambda r: r["doc_id"])
    texts = [t or "" for t in corpus]
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    for i, r in enumerate(rows):
        nxt = texts[(i + 1) % len(texts)]
        q = len(texts[i]) // 4
        e = texts[i][: len(texts[i]) - q] + nxt[:q]
        jac = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and r["n_chars"] == len(texts[i])
        assert abs(r["near_edited"] - jac(shingles(texts[i]), shingles(e))) < 0.15 and abs(r["near_next"] - jac(shingles(texts[i]), shingles(nxt))) < 0.15
    by = collections.defaultdict(set)
    for t, r in zip(texts, rows):
        by[t].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert fingerprints.compare_with_next(docs_of(spark, ["only one"])).first()["near_next"] == 1.0
    assert fingerprints.compare_with_next(docs_of(spark, []).limit(0)).count() == 0


def leaks(texts, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = BENCH_WORD.findall(lower(t))
        for j in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[j : j + 10])].add(str(i))
    for t in texts:
        w, hit, found = BENCH_WORD.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[k]
        yield len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, n, 60)) for i, n in enumerate([30, 10, 11, 9, 5, 3, 1, 50])] + [(8, None), (9, "..."), (10, "a b a b a b a b a b a b"), (2, prose(rng, 14, 60))]
    cut = lambda t, a, b: " ".join((t or "").split()[a:b])
    texts = [*ODD, *(f"{prose(rng, 20)} {cut(t, 0, 10).upper()}! {prose(rng, 5)}" for _, t in items), *(f"{prose(rng, 3)} {cut(t, 3, 14)} x {cut(t, 2, 11)}" for _, t in items), "a b a b a b a b a b a b a b", *(prose(rng, 30, 60) for _ in range(20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs_of(spark, texts)
    got = [tuple(r)[1:] for r in sorted(decontamination.find_leaks(d, bench).collect())]
    assert got == list(leaks(texts, items))
    kept = decontamination.drop_leaks(d, bench)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, g in enumerate(got) if not g[4]}
    assert decontamination.find_leaks(d, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_decontamination_runs_no_python(spark, monkeypatch):
    plans = []

    def watched(df, what):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, what)

    monkeypatch.setattr(decontamination, "settle", watched)
    d, b = docs_of(spark, ODD), spark.createDataFrame([(1, "x y")], "item_id long, text string")
    for out in (decontamination.find_leaks(d, b), decontamination.drop_leaks(d, b)):
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 8 and not any(re.search("Python|Arrow|Pandas", p) for p in plans)


@pytest.mark.parametrize("small", [0, 10**6])
def test_decontamination_of_null_and_repeated_ids(spark, monkeypatch, small):
    """Also with both sides shuffled, names that clash, and one k-gram that all items share."""
    monkeypatch.setattr(decontamination, "SMALL", small)
    monkeypatch.setattr(decontamination, "MEETING", small)
    rng = random.Random(8)
    common = "one two three four five"
    items = [(i, f"{prose(rng, 8)} {common} {prose(rng, 8)}") for i in range(30)]
    texts = [items[3][1], items[4][1], f"{common} {prose(rng, 30)}", prose(rng, 20), items[3][1], None, f"{common} " * 40]
    rows = [(7 if i < 3 else None, t, "x", "y", 1) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_hit string, item string, h1 int")
    got = sorted(((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontamination.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()))
    assert got == sorted((r[0] or -1, *x) for r, x in zip(rows, leaks(texts, items)))
    kept = decontamination.drop_leaks(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns and sorted(map(str, (r["text"] for r in kept.collect()))) == sorted(map(str, [texts[i] for i in (2, 3, 5, 6)]))


def test_language_id(spark):
    rng = random.Random(2)
    lands = {"en": ["the", "and", "with", "thing", "over"], "de": ["der", "und", "nicht", "schon", "über"], "fr": ["le", "et", "avec", "déjà", "où"]}
    texts = [(i, " ".join(rng.choice(lands[k]) for _ in range(30)), k, f"h{k}") for i, k in enumerate(sorted(lands) * 40)]
    train = spark.createDataFrame([t for t in texts if t[0] % 4], "doc_id long, text string, lang string, host string")
    test = spark.createDataFrame([*[(i, t, None, h) for i, t, _, h in texts if not i % 4], (900, "", "x", "hde"), (901, None, None, None), (902, "12 34", None, "hfr"), (903, "ou", None, "hfr")], "doc_id long, text string, lang string, host string")
    model = language_id.fit(train)
    got = {r["doc_id"]: r for r in language_id.identify(test, model, host=F.col("host"), domain=F.col("host"), suffix=F.lit("x")).collect()}
    assert np.mean([got[i]["lang"] == k for i, _, k, _ in texts if not i % 4]) > 0.99 and all(got[i]["accepted"] for i, *_ in texts if not i % 4)
    assert not got[900]["accepted"] and not got[901]["accepted"] and not got[902]["accepted"] and got[902]["lang"] == "fr" and got[903]["lang"] == "fr"
    assert language_id.identify(test.limit(0), model).count() == 0


def test_address_parts(spark):
    d = spark.createDataFrame([("http://a.b.example.co.uk:8/x?y",), ("https://u@example.de",), ("ftp://localhost/",), (None,), ("no address",)], "u string")
    p = language_id.host_parts(F.col("u"))
    assert [tuple(r) for r in d.select(p["host"], p["domain"], p["suffix"]).collect()] == [("a.b.example.co.uk", "example.co.uk", "uk"), ("example.de", "example.de", "de"), ("localhost", "localhost", "localhost"), (None, None, None), (None, None, None)]


def test_license_scan(spark):
    rng = random.Random(4)
    mit = "Released under the MIT License."
    rows = [("a/LICENSE", licenses.TEMPLATES[3][1]), ("a/x.py", prose(rng, 40)), ("a/b/y.py", prose(rng, 40)), ("a/b/z.py", f"{prose(rng, 30)}\nLicensed under the Apache License, Version 2.0.\n{prose(rng, 30)}"), ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/e.py", prose(rng, 9)), ("q.py", mit), ("r.py", prose(rng, 5)), (None, mit), ("ab/x", None), ("s/only", "the license of this work is under version control")]
    d = spark.createDataFrame([(i, p, t, "clash") for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, license string")
    got = {r["doc_id"]: (r["license"], r["inherited_license"], r["inherited_from"], r["effective_license"]) for r in licenses.scan(d.repartition(2), F.col("path")).collect()}
    assert got[0][0] == "MIT" and got[1] == (None, "MIT", "a", "MIT") and got[2] == (None, "MIT", "a", "MIT") and got[3] == ("Apache-2.0", "MIT", "a", "Apache-2.0")
    assert got[4][0] == "GPL-3.0" and got[5] == (None, "GPL-3.0", "a/b/c", "GPL-3.0") and got[6][0] == "MIT" and got[7][1:3] == ("MIT", "")
    assert got[8] == ("MIT", None, None, "MIT") and got[9] == (None, "MIT", "", "MIT") and got[10][0] is None
    assert licenses.scan(d.limit(0), F.col("path")).count() == 0


def test_ctw_is_a_probability_and_learns(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(40)) for _ in range(60)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    code, at = ctw.codes(*ctw.plain(data, offs))
    assert np.diff(at).tolist() == [len(t) + 1 for t in texts]
    for depth in (0, 2, 5):
        c, n = ctw.tally(code, depth)
        tree = ctw.ContextTree(c, n, depth)
        for ctx in (b"alpha", b"zzzzz"):
            q = np.array([(int.from_bytes(ctx, "big") << 8 | k) & int(ctw.ending(depth)) for k in range(256)], np.uint64)
            assert (10 ** tree._walk(q)).sum() == pytest.approx(1, abs=1e-4)
        bits = -tree.score(code, at).sum() / np.log10(2) / len(code)
        assert bits < {0: 4.2, 2: 2.1, 5: 0.6}[depth]


def test_kt_block_probability():
    assert np.exp(ctw.log_kt(np.array([0.0, 1, 2, 40]), np.array([0.0, 0, 1, 3]))) == pytest.approx([1, 0.5, 1 / 16, np.exp(np.sum(np.log([(k + 0.5) / (k + 1) for k in range(40)])) + np.sum(np.log([(j + 0.5) / (41 + j) for j in range(3)])))])


def test_lm_scores(spark, corpus):
    texts = corpus + [prose(random.Random(i), 50) for i in range(60)]
    d = docs_of(spark, texts).withColumn("held_out", lm_scoring.held_out(F.col("doc_id")))
    got = {r["doc_id"]: r for r in lm_scoring.score(d, lm_scoring.train(d.filter("not held_out"))).collect()}
    words = [WORD.findall(lower(t)) for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = collections.Counter()
    for w, h in zip(words, held):
        if not h:
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    for i, w in enumerate(words):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None])) and r["score"] < 0
    rows = [got[i] for i in range(len(texts)) if held[i]]
    assert sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows) > -4


def test_lm_tree_in_parts_is_the_whole_tree(spark, monkeypatch):
    """Contexts stay 5 bytes whatever the number of strings, and dealing them changes no score."""
    rng = random.Random(9)
    texts = [*ODD, *("".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(400))) for _ in range(150)), "ßéñ " * 9]
    d = docs_of(spark, texts).withColumn("held_out", lm_scoring.held_out(F.col("doc_id")))
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]

    def codes(own):
        raw = [(t or "").encode() for t in own]
        return ctw.codes(*ctw.plain(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)))

    tree = ctw.ContextTree(*ctw.tally(codes([t for t, h in zip(texts, held) if not h])[0], 5), 5)
    want = tree.score(*codes(texts))
    monkeypatch.setattr(lm_scoring, "STRINGS_A_TASK", 1000)
    monkeypatch.setattr(lm_scoring, "STRINGS", 1000, raising=False)
    for model in (lm_scoring.train(d.filter("not held_out")), lm_scoring.train(d, ~F.col("held_out"))):
        got = {r["doc_id"]: r["score"] for r in lm_scoring.score(d, model).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(list(want), rel=1e-4, abs=1e-4)
    assert lm_scoring.score(d.limit(0), lm_scoring.train(d.limit(0))).count() == 0


def test_texts_of_no_known_language_are_rejected(spark):
    rng = random.Random(13)
    lands = {"en": "the and with thing over house small never people water through again work year where".split(), "de": "der und nicht schon über haus klein wasser durch leute wieder arbeit jahr wohin immer".split()}
    text = lambda k: " ".join(rng.choice(lands[k]) for _ in range(rng.randrange(5, 80)))
    train = spark.createDataFrame([(text(k), k) for k in sorted(lands) for _ in range(100)], "text string, lang string")
    clean = [text(k) for k in sorted(lands) for _ in range(50)] + ["The house."]
    letters = "abcdefghijklmnopqrstuvwxyz"
    foreign = ["Все люди рождаются свободными и равными в своём достоинстве и правах", "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "".join(rng.choice(letters + letters.upper() + "0123456789+/") for _ in range(300))]
    foreign += [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(40)) for _ in range(5)]
    d = spark.createDataFrame(list(enumerate([*clean, *foreign])), "doc_id long, text string")
    got = {r["doc_id"]: r["accepted"] for r in language_id.identify(d, language_id.fit(train)).collect()}
    assert [got[i] for i in range(len(clean) + len(foreign))] == [True] * len(clean) + [False] * len(foreign)


def test_documents_that_meet_items_are_told_by_broadcast_hashes(spark, monkeypatch):
    """One document that meets an item at many k-grams is one, so its text is found without dealing out all texts; both ways agree."""
    from tessera.llm import decontamination as D

    item = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a b {item} c"), (2, "x " * 30), (None, item[:40])], "doc_id long, text string")
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    plans, settle = {}, D.settle
    monkeypatch.setattr(D, "settle", lambda df, what="table": plans.update({what: df._jdf.queryExecution().executedPlan().toString()}) or settle(df, what))
    monkeypatch.setattr(D, "MEETING", 2)
    near = sorted(map(str, D.find_leaks(docs, bench).collect()))
    assert "BroadcastHashJoin" in plans["met_texts"] and "SortMergeJoin" not in plans["met_texts"]
    monkeypatch.setattr(D, "MEETING", 0)
    assert sorted(map(str, D.find_leaks(docs, bench).collect())) == near and "n_hit=60" in "".join(near)


def test_strings_of_several_pieces_share_one_hash_table():
    from tessera.llm import ctw

    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 40, n).astype(np.uint64) for n in (300, 0, 7, 500)]
    distinct, place, numbers = ctw.encoded(ctw.together(parts))
    assert list(distinct) == sorted(set(np.concatenate(parts).tolist()))
    assert [list(distinct[place[x]]) for x in numbers] == [list(x) for x in parts]
    values, n = ctw.tally(parts)
    assert dict(zip(values.tolist(), n.tolist())) == {v: int((np.concatenate(parts) == v).sum()) for v in distinct.tolist()}
    nothing = ctw.encoded(ctw.together([]))
    assert not len(nothing[0]) and nothing[2] == []
    out, begin = ctw.plain(np.frombuffer(b"Ab c" + b"d", np.uint8), np.array([0, 4, 5]))
    code, at = ctw.codes(out, begin)
    assert [int(c).to_bytes(8, "big")[-4:] for c in code] == [b"\n\n\na", b"\n\nab", b"\nab ", b"ab c", b"b c\n", b"\n\n\nd", b"\n\nd\n"] and list(at) == [0, 5, 7]
