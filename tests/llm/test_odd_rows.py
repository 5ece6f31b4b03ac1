"""Every operator and every pipeline stage on empty tables, nulls, repeats, long texts and names that clash."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import archives, content_store, decontamination, fingerprints, language_id, licenses, lm_scoring, mixing, ngram_join, queries, token_counts
from tessera.llm.common import fresh_path

TOKENIZER = queries.tokenizer_path()
CLASH = ["h", "d", "l", "m", "n", "w", "at", "row", "label", "cls", "low", "size", "part", "k", "run", "tie", "mark", "item", "post", "ll", "fit", "score", "address", "__text", "__w", "__items", "__dir", "__path", "up", "name", "__h", "b", "got"]


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    one = prose(40)
    return [one, one, prose(30), "", None, " \n", "x", one + " end", prose(1_200_000), prose(12), "é ß 日本"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, equal and null ids, equal rows, one text of some 6 MB."""
    rows = [(i if i % 3 else None, t, "en" if i % 2 else None, f"s{i % 2}" if i % 4 else None, i) for i, t in enumerate(texts())]
    rows += [rows[0], (1, "another text of that id", "de", "s0", 1), (1, None, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).cache()


def arc_and_back(df):
    spark = df.sparkSession
    legacy, path = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    archives.write_arc(archives.to_arc(df.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *[f"`{c}`" for c in df.columns if c in CLASH])), legacy)
    archives.write_warc(archives.to_warc(archives.read_arc(spark, legacy)), path)
    return archives.read_warc(spark, path).drop("record_id")


def store(df):
    path = fresh_path(df.sparkSession, "ids")
    content_store.write_store(df, TOKENIZER, path)
    return content_store.read_index(df.sparkSession, path)


def lm(df):
    clean = df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("held_out", lm_scoring.held_out(F.col("doc_id")))
    return lm_scoring.score(clean, lm_scoring.train(clean, ~F.col("held_out")))


def bench(spark):
    return spark.createDataFrame([(1, texts()[0]), (None, "x"), (2, None), (3, "x"), (3, "x")], "item_id long, text string")


OPERATORS = {
    "ngram_join": ngram_join.near_groups,
    "archives": arc_and_back,
    "language_id": lambda df: language_id.identify(df, language_id.fit(df), host=F.col("source")).select("doc_id", "text_lang", "lang", "confidence", "accepted"),
    "mixing": lambda df: mixing.mix(df.withColumn("size", mixing.words_in(F.col("text"))), "size").select("doc_id", "source", "size", "source_size", "target", "taken"),
    "licenses": lambda df: licenses.scan(df, F.concat_ws("/", "source", "doc_id")).select("doc_id", "license", "effective_license"),
    "lm_scoring": lm,
    "token_counts": lambda df: token_counts.count_tokens(df, TOKENIZER).select("doc_id", "n_bytes", "n_tokens", "over_limit"),
    "content_store": store,
    "fingerprints": fingerprints.compare_with_next,
    "decontamination": lambda df: decontamination.find_leaks(df, bench(df.sparkSession)),
}
rounded = lambda df: sorted(map(str, ([round(v, 6) if isinstance(v, float) else v for v in r] for r in df.collect())))


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, odd, name):
    run = OPERATORS[name]
    got = rounded(run(odd))
    assert len(got) == odd.count()
    assert run(odd.limit(0)).count() == 0
    clash = odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH) if not (name == "mixing" and c == "size")])
    if name == "content_store":  # `start` of equal ids goes by their roots, so all is defined
        assert rounded(run(clash)) == got
    else:
        assert rounded(run(clash)) == got


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", STAGES)
def test_stage(spark, odd, name, tmp_path):
    bench(spark).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    run = lambda df: STAGES[name](spark, df, f"file://{tmp_path}")
    out = run(odd)
    rows = out.collect()
    if name != "token_store":
        assert out.columns == odd.columns
        have = {(r["doc_id"], r["text"]) for r in odd.collect()}
        assert {(r["doc_id"], r["text"]) for r in rows} <= have
    kept = [(r["doc_id"], r["text"]) for r in rows] if name != "token_store" else []
    t = texts()
    if name == "token_store":
        assert len(rows) == odd.count()
    if name == "near_duplicates":  # one of the copies; all that have no words, whatever their ids
        assert sum(x in (t[0], t[7]) for _, x in kept) == 1 and sum(not (x or "").strip() for _, x in kept) == 5 and len(kept) == odd.count() - 3
    if name == "decontamination":
        assert t[0] not in [x for _, x in kept] and "x" not in [x for _, x in kept] and len(kept) == odd.count() - 5
    if name == "language_id":  # no letters, no language
        assert not any((x or "").strip() == "" for _, x in kept)
    if name == "mixing":
        assert kept and not any((x or "").strip() == "" for _, x in kept)
    assert run(odd.limit(0)).count() == 0


def test_tokenizers_of_every_kind(spark):
    """A file whose rules allow no cuts, and a sentencepiece model, give what their libraries give."""
    import sentencepiece
    from tokenizers import Tokenizer

    rows = [t for t in texts() if t is None or len(t) < 10_000]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    words, piece = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    want = {words: [len(e.ids) for e in Tokenizer.from_file(words).encode_batch([t or "" for t in rows], add_special_tokens=False)], piece: list(map(len, sentencepiece.SentencePieceProcessor(model_file=piece).encode([t or "" for t in rows])))}
    for path, n in want.items():
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(d, path).collect()}
        assert [got[i] for i in range(len(rows))] == n
