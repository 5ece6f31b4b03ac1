"""Column expressions of the ranking model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import WORK

# Fixed values of the ranking model.
MEDIAN_WORDS = 2500
PRECISION_EPS = 1e-9
FLUX_EPS = 1e-12
NEGATIVE_LAMBDA = 3.0
STALE_MS = 7 * 24 * 60 * 60 * 1000


def hub_frequency(calibrated: Column, estimated: Column) -> Column:
    return F.coalesce(calibrated, estimated, F.lit(1.0))


def tag_weight(freq: Column) -> Column:
    """Popular hubs pass less: 1 / ln(freq + 1), for a freq of 1 at least."""
    return 1.0 / F.log(F.greatest(freq, F.lit(1.0)) + 1.0)


def row_out_fraction(kind: Column, status: Column, freq: Column, degree: Column) -> Column:
    """The share of a node's links that has been observed."""
    d = degree.cast("double")
    return (
        F.when(d <= 0, 0.0).when(status == "complete", 1.0).when(kind == WORK, d / (d + 1.0))
        .otherwise(F.least(F.lit(1.0), d / F.greatest(freq, F.lit(1.0))))
    )


def work_prior(word_count: Column) -> Column:
    return F.when(word_count > 0, F.log(F.when(word_count > 0, word_count) / float(MEDIAN_WORDS))).otherwise(0.0)


def precision_prior(a: Column) -> Column:
    return 1.0 + F.log1p(F.exp(a))


def expected_info(relevance: Column, authority: Column, precision: Column) -> Column:
    return relevance * authority / (precision + PRECISION_EPS)


def potential(relevance: Column, authority: Column) -> Column:
    return F.sqrt(F.greatest(relevance, F.lit(0.0)) * F.greatest(authority, F.lit(0.0)))


def is_stale(explored_at: Column, now: int, stale: int = STALE_MS) -> Column:
    return explored_at.isNull() | (F.lit(now) - explored_at >= stale)


def is_expandable(kind: Column, status: Column, explored_at: Column, now: int, stale: int = STALE_MS) -> Column:
    """Not complete; or a complete hub whose listing is old enough to have grown."""
    return F.when(status != "complete", True).when(kind == WORK, False).otherwise(is_stale(explored_at, now, stale))


def merge_status(a: Column, b: Column) -> Column:
    """The further of two exploration states."""
    order = F.array(F.lit("unexplored"), F.lit("partial"), F.lit("complete"))
    return F.element_at(order, F.greatest(F.array_position(order, a), F.array_position(order, b)).cast("int"))
