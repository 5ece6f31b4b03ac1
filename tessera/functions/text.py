"""Text scalars: fuzzy scores, counts in headings, completion states, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as a browser trims it.
_SPACE = "[\\s\\u00a0\\ufeff]"
REDACTED = "Redacted"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def number_in(text: Column, pattern: str) -> Column:
    """The pattern's first group as a number, commas taken out; null if there is none."""
    return F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("bigint")


def work_count(heading: Column) -> Column:
    return number_in(heading, r"(?i)([\d,]+)\s+Works?")


def found_count(heading: Column) -> Column:
    return F.coalesce(work_count(heading), number_in(heading, r"(?i)([\d,]+)\s+Found"))


def page_words(text: Column) -> Column:
    """A work page names the unit."""
    return number_in(text, r"(?i)([\d,]+)\s+Words?")


def blurb_words(text: Column) -> Column:
    """A listing only begins with the figure."""
    return number_in(trimmed(text), r"^([\d,]+)")


def completion_of_chapters(text: Column) -> Column:
    """`3/3` is Complete, `3/?` and `3/5` are Incomplete; anything else tells nothing."""
    t = trimmed(text)
    pattern = r"^([\d,]+)\s*/\s*([\d,?]+)"
    total = F.regexp_extract(t, pattern, 2)
    published, n = (F.regexp_replace(F.regexp_extract(F.regexp_replace(x, ",", ""), r"^(\d+)", 1), "^$", "x").try_cast("bigint") for x in (F.regexp_extract(t, pattern, 1), total))
    return (
        F.when(~t.rlike(pattern) | t.isNull(), None).when(total == "?", "Incomplete")
        .when(published.isNull() | n.isNull() | (n <= 0), None).when(published >= n, "Complete").otherwise("Incomplete")
    )


def completion_of_label(text: Column) -> Column:
    t = F.lower(trimmed(text))
    return F.when(t.isin("complete", "completed"), "Complete").when(t.isin("incomplete", "work in progress", "wip"), "Incomplete")


def unique_texts(values: Column) -> Column:
    """Trimmed, without empty ones, each once in order."""
    return F.array_distinct(F.filter(F.transform(values, trimmed), lambda v: v != ""))


def split_commas(text: Column) -> Column:
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(unique_texts(F.split(text, ",")))


def display_name(heading: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(heading, r"(?i)\s*-\s*Works.*$", ""), r"(?i)^Works by\s+", ""))


def is_redacted(name: Column) -> Column:
    return trimmed(name) == REDACTED


def fuzzy_score(query: str, candidate: Column) -> Column:
    """How well a candidate matches, case aside; null if it does not.

    The whole 1000; a beginning 900 and up to 80 by its share; a part 800 less its
    place (40 at most); else the query's letters in order: 10 each, 6 more for every
    one in a row, 12 at a word's start and less its place (24 at most) where a run begins.
    """
    q = query.strip().lower()
    if not q:
        return F.lit(None).cast("double")
    text = F.lower(candidate)
    letters = F.array(*[F.lit(c) for c in q])
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("score"))

    def step(s: Column, k: Column) -> Column:
        here = F.substring(text, k + 1, F.lit(1))
        hit = (s["i"] < len(q)) & (here == F.element_at(letters, F.least(s["i"] + 1, F.lit(len(q)))))
        joined = s["last"] == k - 1
        before = F.when(k > 0, F.substring(text, k, F.lit(1))).otherwise(" ")
        fresh = F.when(before.isin(" ", "-", "("), 12).otherwise(0) - F.least(k, F.lit(24))
        gain = 10 + F.when(joined, (s["run"] + 1) * 6).otherwise(fresh)
        return F.struct(F.when(hit, s["i"] + 1).otherwise(s["i"]).alias("i"), F.when(hit, k).otherwise(s["last"]).alias("last"), F.when(hit, F.when(joined, s["run"] + 1).otherwise(0)).otherwise(s["run"]).alias("run"), F.when(hit, s["score"] + gain).otherwise(s["score"]).alias("score"))

    walked = F.aggregate(F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>")), start, step)
    at = F.instr(text, q)
    return (
        F.when(text == q, 1000.0).when(text.startswith(q), 900.0 + F.lit(float(len(q))) / F.length(text) * 80.0)
        .when(at > 0, (F.lit(800) - F.least(at - 1, F.lit(40))).cast("double"))
        .when(walked["i"] == len(q), walked["score"].cast("double"))
    )


def fuzzy_top(names: DataFrame, query: str, k: int = 10, name: str = "key", freq: str = "freq") -> DataFrame:
    """The k best matches: score, then frequency, then name."""
    scored = names.withColumn("score", fuzzy_score(query, F.col(name))).filter("score is not null")
    return scored.orderBy(F.desc("score"), F.desc(freq), F.col(name)).limit(k)
