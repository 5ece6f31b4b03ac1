"""Language identification by Bayesian evidence fusion.

log posterior(l) = text likelihood + log P(declared | l) + log address prior(l)

The text likelihood is that of hashed byte trigrams, fitted here on labelled texts. The
other two come from grouped counts of what the text alone says over all rows: how often
a declared language goes with each language, and a prior by address, whose host's counts
shrink to its domain's, those to its suffix's, and those to the corpus's. A row without
a host has the prior of its domain, one without that the suffix's, else the corpus's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, settle, tidy, utf8
from .shingles import LOWER

#: Hash slots of trigrams, and labelled texts of a language that the fit uses (of least hash).
SLOTS, LABELLED = 1 << 15, 4_000
#: Weight of the smoothing counts in trigrams, and of a level's prior in the level below.
SMOOTH, SHRINK = 0.5, 10.0
#: Bytes of evidence at which a text's likelihood no longer sharpens: trigrams are not independent.
SATURATE = 200.0
#: A text is rejected if no language has this share of the posterior, or it has no letters.
LEAST = 0.4
#: It is also rejected if its mean log likelihood in its language lies below that of labelled
#: texts by more than FAR deviations between texts and NEAR of a mean of so few trigrams
#: together; a trigram counts as 1 / OVERLAP of an independent one.
FAR, NEAR, OVERLAP = 18.0, 4.0, 3.0
#: Least deviation between texts, for labelled texts that are all alike.
LEAST_BETWEEN = 0.1

#: Distinct addresses and declarations up to which their evidence is broadcast (some 500 bytes each); beyond, rows are shuffled.
KNOWN = 40_000

# Second-level labels under which registered names are one label longer.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass
class TextModel:
    """Languages in order, and log P(trigram slot | language) as [slot, language].

    usual: for each language the mean of its labelled texts' log likelihoods a trigram,
    the variance between texts, and that inside them.
    """

    languages: list[str]
    table: np.ndarray
    usual: np.ndarray


def _slots(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams inside each text, runs of other bytes than letters as one blank; n + 1 offsets."""
    sym = LOWER[data]
    letter = ((sym >= 97) & (sym <= 122)) | (sym >= 128)
    sym = np.where(letter, sym, 32).astype(np.uint32)
    n = np.diff(offs)
    if len(sym) < 3:
        return np.empty(0, np.int64), np.zeros(len(n) + 1, np.int64)
    code = sym[:-2] << np.uint32(16) | sym[1:-1] << np.uint32(8) | sym[2:]
    ok = letter[:-2] | letter[1:-1] | letter[2:]
    edge = offs[1:-1]
    for back in (1, 2):  # trigrams across two texts
        at = edge - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    kept = np.concatenate([[0], np.cumsum(ok)])
    slot = ((code[ok] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    return slot, kept[np.minimum(offs, len(ok))]


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", most: int = LABELLED) -> TextModel:
    """Count trigrams by language over at most `most` labelled texts of each (a documented sample for fitting).

    The sample is by a hash of the text, so it does not depend on the order of rows;
    null labels are left out; without any (or any rows) the model has no languages. Counts
    are summed over tasks; SLOTS rows a language reach the driver.
    """
    rows = labelled.filter(F.col(label).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return TextModel([], np.zeros((SLOTS, 0), np.float32), np.zeros((0, 3)))
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, most / n)).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    languages = sorted(sizes)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), SLOTS), np.int64)
        for batch in batches:
            for part in pieces(batch):
                slot, at = _slots(*utf8(part.column(0)))
                which = np.array([languages.index(x) for x in part.column(1).to_pylist()], np.int64)
                key = np.repeat(which, np.diff(at)) * SLOTS + slot
                total += np.bincount(key, minlength=total.size).reshape(total.shape)
        lang, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[lang, slot])], names=["lang", "slot", "n"])

    counts = sample.mapInArrow(run, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.full((len(languages), SLOTS), SMOOTH)
    total[counts["lang"].to_numpy(), counts["slot"].to_numpy()] += counts["n"].to_numpy()
    table = np.log(total / total.sum(1, keepdims=True))
    return TextModel(languages, np.ascontiguousarray(table.T.astype(np.float32)), _usual(sample, languages, total))


def _usual(sample: DataFrame, languages: list[str], total: np.ndarray) -> np.ndarray:
    """TextModel.usual from the sample, each text by the counts of the others."""
    told = sample.sparkSession.sparkContext.broadcast(total)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), 5))  # texts, mean, its square, variance inside, that over the text's size
        all_n = told.value.sum(1)
        for batch in batches:
            for part in pieces(batch):
                slot, at = _slots(*utf8(part.column(0)))
                n = np.diff(at)
                text = np.repeat(np.arange(len(n)), n)
                which = np.array([languages.index(x) for x in part.column(1).to_pylist()], np.int64)
                _, where, own = np.unique(text * SLOTS + slot, return_inverse=True, return_counts=True)
                ll = np.log(told.value[which[text], slot] - own[where]) - np.log(all_n[which] - n)[text]
                full = np.flatnonzero(n)
                mean = np.bincount(text, ll, len(n))[full] / n[full]
                inside = np.maximum(np.bincount(text, ll**2, len(n))[full] / n[full] - mean**2, 0)
                for j, v in enumerate((np.ones(len(full)), mean, mean**2, inside, inside * OVERLAP / n[full])):
                    sums[:, j] += np.bincount(which[full], v, len(languages))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(languages), dtype=np.int32)), *[pa.array(c.copy()) for c in sums.T]], names=["lang", "s0", "s1", "s2", "s3", "s4"])

    got = sample.mapInArrow(run, "lang int, s0 double, s1 double, s2 double, s3 double, s4 double").groupBy("lang").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(5)]).toArrow()
    sums = np.zeros((len(languages), 5))
    sums[got["lang"].to_numpy()] = np.stack([got[f"s{j}"].to_numpy() for j in range(5)], 1).reshape(-1, 5)
    sums /= np.maximum(sums[:, :1], 1)
    between = np.maximum(sums[:, 2] - sums[:, 1] ** 2 - sums[:, 4], LEAST_BETWEEN**2)
    return np.stack([sums[:, 1], between, sums[:, 3]], 1)


def likelihoods(model: TextModel, text: Column) -> Column:
    """Struct of `ll`, the tempered log likelihood of each language, and `fit`, what its mean lies above the least that labelled texts allow; null for a text without letters."""

    def of(piece: pa.Array) -> pa.Array:
        table, (usual, between, inside) = model.table, model.usual.T
        slot, at = _slots(*utf8(piece))
        n = np.diff(at)
        total = np.zeros((len(n), table.shape[1]))
        full = np.flatnonzero(n)
        for k in range(table.shape[1]) if len(full) else ():
            total[full, k] = np.add.reduceat(table[:, k][slot].astype(np.float64), at[:-1][full])
        size = np.maximum(n, 1)[:, None]
        fit = total / size - usual + FAR * np.sqrt(between) + NEAR * np.sqrt(inside * OVERLAP / size)
        total *= (np.minimum(n, SATURATE) / np.maximum(n, 1))[:, None]
        edges = pa.array(np.arange(len(n) + 1, dtype=np.int32) * table.shape[1])
        lists = [pa.ListArray.from_arrays(edges, pa.array(x.ravel())) for x in (total, fit)]
        return pa.StructArray.from_arrays(lists, names=["ll", "fit"], mask=pa.array(n == 0))

    @F.arrow_udf("ll array<double>, fit array<double>")
    def tell(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts.fill_null("")], names=["text"])
        parts = [of(part.column(0)) for part in pieces(batch, "text")]
        return pa.concat_arrays(parts) if parts else of(batch.column(0))

    return tell(F.coalesce(text, F.lit("")))


def host_parts(url: Column) -> dict[str, Column]:
    """host, registered domain and suffix of an address; null where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    labels = F.split(host, r"\.")
    wide = F.element_at(labels, -2).isin(*SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    n = F.when((F.size(labels) >= 3) & wide, 3).otherwise(2)
    domain = F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -F.least(n, F.size(labels)), F.least(n, F.size(labels))), ".")).otherwise(host)
    return {"host": host, "domain": domain, "suffix": F.element_at(labels, -1)}


def declared_language(html: Column) -> Column:
    """The primary subtag that the root element declares, lower case; null if none."""
    tag = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(tag != "", tag)


def visible_text(html: Column) -> Column:
    """Markup, scripts and styles taken out."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&[A-Za-z#0-9]+;", " ")


def identify(df: DataFrame, model: TextModel, text: str = "text", declared: Column | None = None, host: Column | None = None, domain: Column | None = None, suffix: Column | None = None) -> DataFrame:
    """df with lang, confidence, text_lang and accepted, from all evidence there is.

    Missing evidence (a null declared language, host, domain or suffix) says nothing. A text
    without letters (null, empty, figures only) is decided by the other evidence but
    never accepted, nor is one that its language's labelled texts make unlikely (another
    language, random letters): that test does not depend on the other languages. Very long
    texts are read whole; repeated rows stay, and each is told alike; of equal posteriors the
    first language by name wins. Columns of df named like a result are replaced, others may
    have any name. A model without languages accepts nothing and tells none. A row's own text
    is taken out of its host's counts, so it is not counted twice.
    """
    langs, k = model.languages, len(model.languages)
    nothing = F.lit(None).cast("string")
    out = ("lang", "confidence", "text_lang", "accepted")
    names_held = [c for c in df.columns if c not in out]
    if not k:
        return df.select(*[F.col(f"`{c}`") for c in names_held], nothing.alias("lang"), F.lit(0.0).alias("confidence"), nothing.alias("text_lang"), F.lit(False).alias("accepted"))
    given = {"declared": declared, "host": host, "domain": domain, "suffix": suffix}
    parts = list(given)
    held = [f"c{i}" for i in range(len(names_held))]  # so that columns may have any name, and unused ones are not carried
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(names_held, held)], F.col(f"`{text}`").alias("text"), *[(v if v is not None else nothing).cast("string").alias(n) for n, v in given.items()])
    scored = rows.withColumn("said", likelihoods(model, F.col("text"))).select(*held, *parts, F.col("said.ll").alias("ll"), F.col("said.fit").alias("fit"))
    top = F.array_max("ll")
    total = F.aggregate("ll", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    scored = scored.withColumn("post", F.when(F.col("ll").isNotNull(), F.transform("ll", lambda x: F.exp(x - top) / total)))

    # Soft counts of what the text alone says, by each key; partial sums, so a hot host is no hot task.
    sums = [F.sum(F.element_at("post", i + 1)).alias(f"n{i}") for i in range(k)]
    by = settle(scored.filter("post is not null").select("post", *parts).groupBy(*parts).agg(*sums), "evidence")
    again = [F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]
    every = by.agg(*again).first()
    n_all = [float(every[i] or 0.0) for i in range(k)]
    prior = [(n + 1.0) / (sum(n_all) + k) for n in n_all]

    def level(keys: list[str], parent: DataFrame | None) -> DataFrame:
        """keys, and a struct of their counts n, the parent's prior up and their own p that shrinks to it."""
        own = by.filter(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(*again)
        up = [F.lit(x) for x in prior]
        if parent is not None:
            own = own.join(parent.select(*[F.col(c).alias(f"u_{c}") for c in keys[:-1]], F.col("told.p").alias("q")), [F.col(c).eqNullSafe(F.col(f"u_{c}")) for c in keys[:-1]], "left")
            up = [F.coalesce(F.element_at("q", i + 1), F.lit(prior[i])) for i in range(k)]
        n = sum((F.col(f"n{i}") for i in range(1, k)), F.col("n0"))
        p = [(F.col(f"n{i}") + SHRINK * up[i]) / (n + SHRINK) for i in range(k)]
        return own.select(*keys, F.struct(F.array(*[f"n{i}" for i in range(k)]).alias("n"), F.array(*up).alias("up"), F.array(*p).alias("p")).alias("told"))

    by_suffix = level(["suffix"], None)
    by_domain = level(["suffix", "domain"], by_suffix)
    by_host = level(["suffix", "domain", "host"], by_domain)
    by_declared = level(["declared"], None)

    def joined(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        keys = right.columns[:-1]
        right = right.select(*[F.col(c).alias(f"r_{c}") for c in keys], F.col("told").alias(name))
        return left.join(right, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in keys], "left").drop(*[f"r_{c}" for c in keys])

    # All keys' evidence is put side by side per distinct combination first, then joined once to the rows.
    known = by.select(*parts)
    for table, name in ((by_host, "of_host"), (by_domain, "of_domain"), (by_suffix, "of_suffix"), (by_declared, "of_declared")):
        known = joined(known, table, name)
    known = known.select(*[F.col(c).alias(f"k_{c}") for c in parts], F.coalesce("of_host", "of_domain", "of_suffix").alias("address"), "of_declared")
    known = settle(known, "known")
    known = F.broadcast(known) if known.count() <= KNOWN else known
    full = scored.join(known, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in parts], "left")

    def term(i: int) -> Column:
        own = F.coalesce(F.element_at("post", i + 1), F.lit(0.0))
        all_n = F.aggregate("address.n", F.lit(0.0), lambda s, x: s + x)
        mine = F.when(F.col("post").isNotNull(), 1.0).otherwise(0.0)
        # Parents count the row too; with SHRINK rows of them that is a small part.
        place = F.when(F.col("address").isNotNull(), (F.greatest(F.element_at("address.n", i + 1) - own, F.lit(0.0)) + SHRINK * F.element_at("address.up", i + 1)) / (F.greatest(all_n - mine, F.lit(0.0)) + SHRINK)).otherwise(F.lit(prior[i]))
        # P(declared | l) = P(l | declared) P(declared) / P(l): what it adds is P(l | declared) / P(l).
        told = F.when(F.col("of_declared").isNotNull(), F.element_at("of_declared.p", i + 1) / F.lit(prior[i])).otherwise(F.lit(1.0))
        return F.coalesce(F.element_at("ll", i + 1), F.lit(0.0)) + F.log(place) + F.log(told)

    full = full.withColumn("score", F.array(*[term(i) for i in range(k)]))
    best = F.array_max("score")
    mass = F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    names = F.array(*[F.lit(x) for x in langs])
    at = F.array_position("score", best).cast("int")
    confidence = 1.0 / mass
    told = full.select(
        *held, F.element_at(names, at).alias("lang"), confidence.alias("confidence"),
        F.when(F.col("ll").isNotNull(), F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int"))).alias("text_lang"),
        (F.col("ll").isNotNull() & (confidence >= LEAST) & (F.element_at("fit", at) >= 0)).alias("accepted"),
    )
    return told.select(*[F.col(a).alias(c) for a, c in zip(held, names_held)], *out)
