"""Pages whose chunks come in any order and over several batches.

A page's chunks are kept as state until event time has passed its last chunk by a gap; then they leave together, and the
jobs for whole pages apply.  What comes for a page after that leaves at once and is marked late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructType

from ..operators.lines import PAGE
from ..options import DEFAULT, ScanOptions
from ..plans.jobs import scan_text
from ..sources.files import link_annotations

CHUNKS = "doc_id long, page_number int, source_rank int, tile_y int, seq int, text string, left_pt double, bottom_pt double, width_pt double, height_pt double, space_width double"


class PageBuffer(StatefulProcessor):
    """Chunks of a page until it closes: gap_ms after the latest one by event time (column at)."""

    def __init__(self, gap_ms: int, columns: list[str], kept: str):
        self.gap_ms, self.columns, self.kept = gap_ms, columns, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", self.kept)
        self.closes = handle.getValueState("closes", "at_ms long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at_ms, closed = self.closes.get() if self.closes.exists() else (None, False)
        for batch in rows:
            if closed:
                yield batch[self.columns].assign(late=True)
                continue
            self.chunks.appendList([tuple(None if pd.isna(v) else getattr(v, "item", lambda v=v: v)() for v in r) for r in batch[self.columns[2:]].itertuples(index=False)])
            latest = int(batch["at"].max().timestamp() * 1000) + self.gap_ms
            if at_ms is None or latest > at_ms:
                if at_ms is not None:
                    self.handle.deleteTimer(at_ms)
                self.handle.registerTimer(latest)
                at_ms = latest
        if not closed:
            self.closes.update((at_ms, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [(*key, *r) for r in self.chunks.get()]
        self.chunks.clear()
        self.closes.update((0, True))
        yield pd.DataFrame(rows, columns=self.columns).assign(late=False)

    def close(self) -> None:
        pass


def closed_pages(chunks: DataFrame, delay: str = "10 minutes", gap_ms: int = 0) -> DataFrame:
    """A stream of CHUNKS rows with an event time (column at), as rows of closed pages (late is false), all rows of a page
    in one batch, and of chunks that came for a page after it had closed (late is true).

    Chunks may be up to `delay` behind the latest event time; what is further behind, Spark drops before it gets here.
    A closed page keeps a few bytes of state.  The state store has to be the one on RocksDB."""
    columns = [f.split()[0] for f in CHUNKS.split(", ")]
    out = StructType(StructType.fromDDL(CHUNKS).fields).add("late", BooleanType())
    kept = ", ".join(CHUNKS.split(", ")[2:])
    grouped = chunks.select(*columns, "at").withWatermark("at", delay).groupBy(*PAGE)
    return grouped.transformWithStateInPandas(PageBuffer(gap_ms, columns, kept), out, "Append", "EventTime")


def link_pages_as_they_close(chunks: DataFrame, annotations: Callable[[], DataFrame], out: str, checkpoint: str, options: ScanOptions = DEFAULT, delay: str = "10 minutes", gap_ms: int = 0, **trigger) -> StreamingQuery:
    """Annotation rows of pages that close in a batch, at out/links/batch=<n>, and late chunks at out/late/batch=<n>; a
    replayed batch overwrites its own.  annotations gives the links to respect, read anew for each batch."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        link_annotations(scan_text(rows.where(~F.col("late")).drop("late"), annotations(), options)).write.mode("overwrite").parquet(f"{out}/links/batch={number}")
        rows.where("late").drop("late").write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        rows.unpersist()

    return closed_pages(chunks, delay, gap_ms).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
