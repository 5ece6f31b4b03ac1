"""Pages as a stream: listings fold into hub states, parsed pages go to a sink batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.html import parse_pages

PAGE_EVENT = "page_id long, url string, html string"
LISTING_EVENT = "hub long, seq long, count long, page int, next_page int"
_STATE = "status string, known long, pages int"
_OUT = "hub long, seq long, explorationStatus string, listingNextPage int, listingPagesFetched int, calibratedFreq long, demoted boolean"


def page_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Pages from Parquet files as they arrive."""
    return spark.readStream.schema(PAGE_EVENT).option("maxFilesPerTrigger", files).parquet(folder)


def fold(state: tuple[str, int | None, int], count: int | None, page: int, following: int | None) -> tuple[tuple[str, int | None, int], int | None, bool]:
    """A hub's state after a page, the page to fetch next, and whether it was demoted."""
    status, known, pages = state
    grew = known is not None and count is not None and count > known
    new = "partial" if grew or following is not None else "complete"
    best = count if known is None else known if count is None else max(known, count)
    return (new, best, max(pages, page)), 1 if grew else following, grew and status == "complete"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at = state.get if state.exists else ("unexplored", None, 0)
    # A batch's rows may come in any order; states follow seq.
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    none = lambda v: None if pd.isna(v) else int(v)
    for r in rows.itertuples():
        at, following, demoted = fold((at[0], none(at[1]) if at[1] is not None else None, int(at[2])), none(r.count_), int(r.page), none(r.next_page))
        out.append((key[0], int(r.seq), at[0], following, at[2], at[1], demoted))
    state.update(at)
    yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _OUT.split(", ")]).astype({"listingNextPage": "Int32", "listingPagesFetched": "int32", "calibratedFreq": "Int64"})


def hub_states(listings: DataFrame) -> DataFrame:
    """Every listing event (LISTING_EVENT) with its hub's state after it."""
    named = listings.withColumnRenamed("count", "count_")
    return named.groupBy("hub").applyInPandasWithState(_advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def ingest(pages: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, paused: Callable[[], bool] = lambda: False) -> StreamingQuery:
    """Parse each batch and hand it to `merge`; while `paused`, batches are dropped, as a running search owns the graph."""

    def batch(df: DataFrame, number: int) -> None:
        if not paused():
            merge(parse_pages(df), number)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
