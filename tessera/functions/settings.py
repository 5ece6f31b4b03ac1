"""Settings brought into their bounds, as a value or as a column of JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds, defaults and closed lists of the settings.
BOUNDS = {"topResults": (1, 200), "maxSeeds": (1, 100), "maxNegativeSeeds": (1, 100), "negativeRelevanceLambda": (0, 50), "queryAStarMaxThinkMs": (0, 60_000)}
DEFAULTS = {"topResults": 25, "maxSeeds": 20, "maxNegativeSeeds": 20, "negativeRelevanceLambda": 3.0, "queryAStarMaxThinkMs": 2_500}
THEMES, POLICIES = ("light", "dark"), ("expected-info", "topo-query", "topological")
CATEGORIES = ("language", "rating", "completionStatus", "archiveWarnings", "fandoms", "categories")
CLOSED = {
    "rating": ("Not Rated", "General Audiences", "Teen And Up Audiences", "Mature", "Explicit"),
    "archiveWarnings": ("Creator Chose Not To Use Archive Warnings", "Graphic Depictions Of Violence", "Major Character Death", "No Archive Warnings Apply", "Rape/Non-Con", "Underage"),
    "completionStatus": ("Complete", "Incomplete"),
    "categories": ("F/F", "F/M", "Gen", "M/M", "Multi", "Other"),
}

_FILTER = "struct<mode:string,permeability:string,values:array<string>>"
SHAPE = "struct<" + ",".join([*(f"{k}:string" for k in (*BOUNDS, "theme", "expansionPolicy")), f"permeability:struct<{','.join(f'{c}:{_FILTER}' for c in CATEGORIES)}>"]) + ">"


def clamp(value: Column, low: float, high: float, fallback: float) -> Column:
    """A number (or a text of one) within bounds; anything else is the fallback."""
    text = F.trim(value)
    n = F.when(text == "", 0.0).otherwise(text.try_cast("double"))
    usable = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return F.when(usable, F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), n))).otherwise(float(fallback))


def clamp_int(value: Column, low: int, high: int, fallback: int) -> Column:
    """As `clamp`, the number rounded first, halves up."""
    text = F.trim(value)
    n = F.when(text == "", 0.0).otherwise(text.try_cast("double"))
    usable = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    rounded = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), n))  # far values would overflow when rounded
    return F.when(usable, F.least(F.lit(high), F.greatest(F.lit(low), F.floor(rounded + 0.5))).cast("long")).otherwise(F.lit(fallback).cast("long"))


def filter_values(category: str, values: Column) -> Column:
    """Trimmed, each once, of a closed list only where there is one; of completion states the first."""
    out = F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != "")))
    if category in CLOSED:
        out = F.filter(out, lambda v: v.isin(*CLOSED[category]))
    return F.slice(out, 1, 1) if category == "completionStatus" else out


def parsed(raw: Column) -> Column:
    """The fields of a JSON text as they stand there."""
    return F.from_json(raw, SHAPE)


def normalized(raw: Column) -> Column:
    """Settings of a JSON text as a struct with every field, whatever the text lacks or has wrong."""
    return F.element_at(F.transform(F.array(parsed(raw)), bounded), 1)  # parsed once a row


def bounded(s: Column) -> Column:
    """`normalized` of parsed fields; s should be a column, as every field of it is looked at."""
    numbers = [(clamp if k == "negativeRelevanceLambda" else clamp_int)(s[k], *BOUNDS[k], DEFAULTS[k]).alias(k) for k in BOUNDS]
    theme = F.when(s["theme"].isin(*THEMES), s["theme"]).otherwise("system").alias("theme")
    policy = F.when(s["expansionPolicy"].isin(*POLICIES), s["expansionPolicy"]).otherwise("topological").alias("expansionPolicy")

    def category(name: str) -> Column:
        f = s["permeability"][name]
        mode = F.when(f["mode"] == "whitelist", "whitelist").otherwise("blacklist")
        return F.struct(mode.alias("mode"), clamp(f["permeability"], 0, 1, 0).alias("permeability"), filter_values(name, f["values"]).alias("values")).alias(name)

    return F.struct(*numbers, theme, policy, F.struct(*map(category, CATEGORIES)).alias("permeability"))
