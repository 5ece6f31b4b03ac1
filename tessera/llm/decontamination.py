"""Benchmark decontamination by winnowing, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Words of a k-gram, and words of a shared span that is always found.
GRAM, SPAN = 5, 10
#: Words of all items together up to which their fingerprints and windows (some 80 bytes a word) are
#: broadcast, and documents that met an item up to which their hashes are (some 30 bytes each); beyond, both sides are shuffled.
SMALL, MEETING = 400_000, 1_000_000
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z as a-z; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _APART), "")


def grams(w: Column, n: int) -> Column:
    """Hashes of the runs of n words, by position."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def winnow(h: Column, window: int) -> Column:
    """The least hash of every window of k-grams, each once."""
    least = F.transform(F.sequence(F.lit(1), F.size(h) - window + 1), lambda i: F.array_min(F.slice(h, i, window)))
    return F.when(F.size(h) >= window, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def fingerprint(w: Column, short: list[int]) -> Column:
    """Winnowed k-grams, and all runs of the lengths that short items have."""
    long = let(grams(w, GRAM), lambda h: winnow(h, SPAN - GRAM + 1))
    return F.concat(long, *[F.array_distinct(grams(w, n)) for n in short]) if short else long


def find_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs (doc_id, text) and bench (item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    An item's windows are its runs of SPAN words, or the whole of a shorter item. A
    document word inside any occurrence of a window is hit. Null or wordless texts have no
    words and match nothing; repeated item_ids count once, a null one is left out; rows of
    docs repeat as given, also with null or repeated doc_ids; very long texts are read
    whole; without benchmark all are clean. Other columns are left out.
    """
    rows = docs.select("doc_id", *_identity("doc_id"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    found = _hits(docs.select("doc_id", "text"), bench).select(*[F.col(c).alias(f"r_{c}") for c in _KEY], "n_hit", "items")
    out = rows.join(found, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in _KEY], "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", F.array_sort("items")), F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_leaks(docs: DataFrame, bench: DataFrame, most: float = 0.0) -> DataFrame:
    """The rows of docs of whose words at most the share `most` is hit, with the columns they have, whatever their names."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_identity("doc_id"), F.size(words(F.col("text"))).alias("n_words") if most else F.lit(0).alias("n_words"))
    dirty = _hits(docs.select("doc_id", "text"), bench).select(*[F.col(c).alias(f"r_{c}") for c in _KEY], "n_hit")
    same = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in _KEY]
    kept = held.join(dirty, [*same, F.col("n_hit") > F.lit(most) * F.col("n_words")], "left_anti")
    return kept.select("row.*")


_KEY = ("id", "h1", "h2")


def _identity(doc_id: str) -> list[Column]:
    """id, h1, h2: what tells a row apart: its doc_id and 128 bits of its text, so null and repeated doc_ids do no harm."""
    return [F.col(doc_id).cast("string").alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def _hits(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(id, h1, h2), n_hit and items (those that occur) of the documents that hold a window of an item.

    Documents and items meet at winnowed k-grams: any shared run of SPAN words has one
    with an equal fingerprint on both sides. Each meeting place is extended to the windows
    that hold it, and those are compared with the items' own, words by words. So the rows
    made are as many as the words near meetings, whatever the number of items that share
    a k-gram; every step is a join or a sum by key.
    """
    w = F.col("w")
    items = bench.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter((F.size("w") > 0) & F.col("item").isNotNull()).distinct()
    size = items.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("n"), F.collect_set(F.when(F.size("w") < SPAN, F.size("w"))).alias("short")).first()  # SPAN - 1 lengths at most
    short = sorted(size["short"])
    near = F.broadcast if size["n"] <= SMALL else lambda df: df
    whole = [F.when(F.size("w") == n, F.array(F.xxhash64("w"))) for n in short]
    marks = near(items.select(F.explode(F.coalesce(*whole, let(grams(w, GRAM), lambda h: winnow(h, SPAN - GRAM + 1)))).alias("mark")).distinct())
    n = F.least(F.size("w"), F.lit(SPAN))
    windows = items.select("item", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).alias("window")).distinct()
    windows = near(windows.select("item", F.col("n").alias("i_n"), F.col("window").alias("i_window")))

    keyed = docs.select(*_identity("doc_id"), "text")
    seen = keyed.select(*_KEY, words(F.col("text")).alias("w")).select(*_KEY, F.explode(fingerprint(w, short)).alias("mark"))
    met = settle(seen.join(marks, "mark", "left_semi").select(*_KEY).distinct(), "met")
    # The texts of documents that met an item, by a hash of what tells them apart: one too many does no harm, as windows are
    # compared. So are places of k-grams that did not meet in their document's fingerprint.
    who = met.select(F.xxhash64(*_KEY).alias("m_who")).distinct()
    who = F.broadcast(who) if who.count() <= MEETING else who
    texts = keyed.join(who, F.xxhash64(*_KEY) == F.col("m_who"), "left_semi").select(*_KEY, words(F.col("text")).alias("w"))
    texts = settle(texts, "met_texts")
    hits = None
    for k, n in ((GRAM, SPAN), *[(n, n) for n in short]):
        at = texts.select(*_KEY, F.posexplode(grams(w, k)).alias("p", "mark"))
        at = at.join(marks, "mark", "left_semi")
        # The windows of n words that hold the k-gram begin up to n - k words before it.
        first = at.groupBy(*_KEY).agg(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.greatest(F.col("p") + 1 - (n - k), F.lit(1)), F.col("p") + 1)))).alias("starts"))
        first = first.select(*[F.col(c).alias(f"s_{c}") for c in _KEY], "starts")
        tried = texts.join(first, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in _KEY]).select(*_KEY, "w", F.explode("starts").alias("at")).filter(F.col("at") + n - 1 <= F.size("w"))
        tried = tried.select(*_KEY, "at", F.lit(n).alias("n"), F.array_join(F.slice(w, F.col("at"), n), " ").alias("window"))
        hits = tried if hits is None else hits.unionByName(tried)
    hits = settle(hits.join(windows, (F.col("n") == F.col("i_n")) & (F.col("window") == F.col("i_window"))).select(*_KEY, "at", "n", "item"), "hits")
    covered = hits.select(*_KEY, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("word")).distinct().groupBy(*_KEY).agg(F.count("*").alias("n_hit"))
    named = hits.select(*_KEY, "item").distinct().groupBy(*_KEY).agg(F.collect_list("item").alias("items"))
    named = named.select(*[F.col(c).alias(f"n_{c}") for c in _KEY], "items")
    return covered.join(named, [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in _KEY]).select(*_KEY, "n_hit", "items")
