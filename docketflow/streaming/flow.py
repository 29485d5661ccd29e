"""The two loops over arriving rows: flag new pages, score new documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docketflow.functions.html import mention_tag

def read_arriving(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as they arrive; the files taken per batch are bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _first(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.sort_values(["ms", "rank"], kind="stable").drop_duplicates("link")


def flag_new_pages(pages: DataFrame, link: str, text: Column, time: str | None = None, late: str = "1 day",
                   keep: timedelta = timedelta(days=30), **tags) -> DataFrame:
    """``link, mention``: each link tagged once, when it is first seen.

    Of several texts that bring a link for the first time, the earliest by ``time`` counts, then the one with the smallest hash,
    whatever tasks read them. What a link that arrives over and over sends to its task is one row per batch of rows. With a
    ``time`` column, rows more than ``late`` behind the latest time are dropped, and a link is forgotten when no page of it has come
    for ``keep``, so the state is bounded by the links of that span; a link that comes back later is flagged anew. Without one
    every link is kept, as a crawl's set of seen links is: use the RocksDB state store where they don't fit in memory.
    """
    forgets, span = time is not None, int(keep.total_seconds() * 1000)
    when = F.col(time).cast("timestamp") if forgets else F.lit(None).cast("timestamp")
    tagged = pages.select(F.col(link).alias("link"), when.alias("time"), F.coalesce(F.unix_millis(when), F.lit(0)).alias("ms"),
                          F.xxhash64(text).alias("rank"), mention_tag(text, F.col(link), **tags).alias("mention"))
    thinned = tagged.mapInPandas(lambda rows: map(_first, rows), tagged.schema)
    if forgets:
        thinned = thinned.withWatermark("time", late)

    def flag(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        firsts = pd.concat(map(_first_and_last, rows))
        best, known = _first(firsts), state.exists
        until = int(firsts["last"].max()) + span
        until = max(until, state.get[0]) if known else until
        state.update((until,))
        if forgets:
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if not known:
            yield best[["link", "mention"]]

    timeout = GroupStateTimeout.EventTimeTimeout if forgets else GroupStateTimeout.NoTimeout
    return thinned.groupBy("link").applyInPandasWithState(flag, "link string, mention string", "until bigint", "append", timeout)


def _first_and_last(batch: pd.DataFrame) -> pd.DataFrame:
    """A link's first row, with the latest time among its rows."""
    return _first(batch).assign(last=batch["ms"].max())


def run_to_end(stream: DataFrame, out: str, checkpoint: str, timeout: float | None = None) -> None:
    """Process everything available and stop. Output files and progress survive a restart."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    if query.isActive:
        query.stop()
        raise TimeoutError("the stream did not finish in time")
    if query.exception() is not None:
        raise query.exception()


def score_arriving(documents: DataFrame, prepare: Callable[[DataFrame], DataFrame],
                   predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The batch steps unchanged: both are row by row, so no state is kept."""
    return predict(prepare(documents))
