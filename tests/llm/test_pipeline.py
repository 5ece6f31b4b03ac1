"""The pipeline against its stages by brute force, on the smallest tables."""

import random
import zlib

import numpy as np

import corpus_pipeline as P
from tessera.llm.queries import tokenizer_path
from tests.llm.test_operators import leaks, shingles

WORDS = "the of and house water people through again never small".split()


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))
    items = [(1, say(20)), (2, say(12))]
    texts = [say(rng.randrange(15, 60)) for _ in range(120)]
    texts += [texts[0], texts[1] + " again", f"{say(9)} {items[0][1]} {say(4)}", "", "12 34", say(30)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:4]:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == list(P.COLUMNS)
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    n = len(rows)
    assert kept["language_id"] == [i for i in range(n) if i not in (n - 3, n - 2)]
    left = kept["language_id"]
    sets = {i: shingles(texts[i]) for i in left}
    unlinked = [i for i in left if not any(j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in left)]
    assert kept["near_duplicates"] == unlinked and n - 5 not in unlinked
    clean = [i for i, x in zip(unlinked, leaks([texts[i] for i in unlinked], items)) if not x[4]]
    assert kept["decontamination"] == clean and n - 4 not in clean
    assert set(kept["mixing"]) <= set(clean) and max(kept["mixing"].count(i) for i in clean) <= 2
    size = {i: len(texts[i].split()) for i in clean}
    assert abs(sum(size[i] for i in kept["mixing"]) - 1.5 * sum(size.values())) <= 60
    out = [tuple(r) for r in P.STAGES[4][1](spark, docs, str(tmp_path)).orderBy("start").collect()]
    t, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for i in kept["mixing"]:
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert out == want
    assert sorted(map(tuple, P.run(spark, str(tmp_path)).collect())) == sorted(want)
    assert P.ORACLE_SQL is None


def test_null_and_repeated_ids_keep_one_row_of_each_group(spark):
    rng = random.Random(12)
    say = lambda: " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(40))
    a, b, c, d, e, f = (say() for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (None, c), (None, c + " again"), (5, d), (5, e), (5, e), (6, e), (7, f), (None, f), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for x in (docs, docs.repartition(3)):
        got = [(r["doc_id"], r["text"]) for r in P.keep_one_of_each_group(spark, x, "").collect()]
        third = [t for i, t in got if i is None and t.startswith(c)]
        assert len(third) == 1
        assert sorted(got, key=str) == sorted([(None, a), (None, b), (None, third[0]), (5, d), (5, e), (7, f), (8, ""), (8, "")], key=str)
