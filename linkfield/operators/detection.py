"""Detector tasks and results: pyramid levels, OCR tiles and words, QR boxes, engines that plug in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import padded_box, pixel_box_to_points
from ..functions.text import is_blank, trimmed
from .lines import PAGE

PIXELS = ("px_left", "px_top", "px_right", "px_bottom")
SIZES = ("page_width_pt", "page_height_pt", "bitmap_width", "bitmap_height")
OCR_WORDS = "doc_id long, page_number int, pass string, tile_y int, seq int, text string, px_left int, px_top int, px_right int, px_bottom int"

# Strips of a page's height in the tile pass, the part of a strip that a step covers.
OCR_STRIPS, OCR_STEP = 6, 0.5


def pyramid_plan(pages: DataFrame, scales: Sequence[float]) -> DataFrame:
    """One detector task per page, level and inversion: level_w, level_h in pixels, inverse_scale back to full size."""
    levels = F.array(*[F.lit(float(s)) for s in scales])
    out = pages.select("*", F.posexplode(levels).alias("level_no", "scale"))
    size = lambda c: F.greatest(F.lit(1), (F.col(c) * F.col("scale")).cast("int"))
    out = out.withColumns({"level_w": size("bitmap_width"), "level_h": size("bitmap_height")})
    out = out.withColumn("inverse_scale", F.col("bitmap_width") / F.col("level_w"))
    return out.select(*PAGE, "level_no", "scale", "level_w", "level_h", "inverse_scale", F.explode(F.array(F.lit(False), F.lit(True))).alias("inverted"))


def rendered_sizes(pages: DataFrame, dpi: int) -> DataFrame:
    """pages with the size of their bitmap at dpi, in whole pixels and one at least."""
    size = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) * dpi / 72).cast("int"))
    return pages.withColumns({"bitmap_width": size("page_width_pt"), "bitmap_height": size("page_height_pt")})


def ocr_tile_plan(pages: DataFrame) -> DataFrame:
    """Overlapping strips of each page's bitmap, top down: tile_y, tile_height.  A bitmap under six pixels has none."""
    strip = F.floor(F.col("bitmap_height") / OCR_STRIPS).cast("int")
    step = F.greatest(F.lit(1), (strip * F.lit(OCR_STEP)).cast("int"))
    tops = F.when(F.col("bitmap_height") > 0, F.sequence(F.lit(0), F.col("bitmap_height") - 1, step))
    out = pages.withColumn("strip", strip).withColumn("tile_y", F.explode(tops))
    return out.withColumn("tile_height", F.least("strip", F.col("bitmap_height") - F.col("tile_y"))).where("tile_height > 0").select(*PAGE, "tile_y", "tile_height")


def attach_page_size(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows with page_width_pt, page_height_pt, bitmap_width, bitmap_height of their page; rows of unknown pages go."""
    return rows.join(pages.select(*PAGE, *SIZES), list(PAGE))


def to_points(rows: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """rows with pixel boxes and, instead of page sizes, boxes in points.  Without pages, rows have their sizes."""
    sized = rows if pages is None else attach_page_size(rows, pages)
    pt = pixel_box_to_points({c: F.col(c) for c in PIXELS}, (F.col("page_width_pt"), F.col("page_height_pt")), (F.col("bitmap_width"), F.col("bitmap_height")))
    return sized.withColumns(pt).drop(*SIZES)


def ocr_words_to_chunks(words: DataFrame, pages: DataFrame) -> DataFrame:
    """OCR words as chunks: blank ones go, texts are trimmed, a tile's words move down by its place; a space is three
    tenths of a word's height.  Whole-page words rank after real text, tiles after them."""
    kept = words.where(~is_blank(F.coalesce("text", F.lit("")))).withColumn("text", trimmed(F.col("text")))
    tile_y = F.when(F.col("pass") == "tile", F.col("tile_y")).otherwise(0)
    kept = kept.withColumns({"px_top": F.col("px_top") + tile_y, "px_bottom": F.col("px_bottom") + tile_y, "tile_y": tile_y, "source_rank": F.when(F.col("pass") == "tile", 2).otherwise(1)})
    out = to_points(kept, pages).withColumn("space_width", F.lit(0.3) * F.col("height_pt"))
    return out.select(*PAGE, "source_rank", "tile_y", "seq", "text", "left_pt", "bottom_pt", "width_pt", "height_pt", "space_width")


def qr_padded_box(detections: DataFrame, pages: DataFrame, sizes: bool = False) -> DataFrame:
    """Detections with pixel boxes at full size, and with their page's sizes if asked; those without points go."""
    sized = attach_page_size(detections.where(F.size(F.coalesce("points", F.array())) > 0), pages)
    level_w = F.greatest(F.lit(1), (F.col("bitmap_width") * F.col("scale")).cast("int"))
    box = padded_box(F.col("points"), F.col("bitmap_width") / level_w)
    return sized.withColumns(box).select(*PAGE, "level_no", "inverted", "decode_no", "payload", *PIXELS, *(SIZES if sizes else ()))


@dataclass(frozen=True)
class OcrEngine:
    """An engine that reads words.

    open sets it up and gives the function that reads a batch of tasks: frames of tasks (columns of the page, with pass,
    tile_y and tile_height) to frames of OCR_WORDS, places within the tile.  It is called once in a worker process, under
    the engine's name.  profile tells Spark what a task of the engine needs (cores, memory, accelerators), so that these
    stages get other executors than the rest."""

    name: str
    open: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
    profile: ResourceProfile | None = None


_opened: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def _opened_once(engine: OcrEngine) -> Callable[[pd.DataFrame], pd.DataFrame]:
    if engine.name not in _opened:
        _opened[engine.name] = engine.open()
    return _opened[engine.name]


def apply_ocr_engine(tasks: DataFrame, engine: OcrEngine | Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None) -> DataFrame:
    """OCR_WORDS rows of an engine (or a function over batches of tasks).  Without an engine there are no rows."""
    if engine is None:
        return tasks.sparkSession.createDataFrame([], OCR_WORDS)
    if not isinstance(engine, OcrEngine):
        return tasks.mapInPandas(engine, OCR_WORDS)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _opened_once(engine)(batch)

    return tasks.mapInPandas(read, OCR_WORDS, profile=engine.profile)


def whole_page_tasks(pages: DataFrame) -> DataFrame:
    """One task for each page that has a bitmap, with all columns of pages."""
    return pages.where("bitmap_width > 0 and bitmap_height > 0").withColumns({"pass": F.lit("whole"), "tile_y": F.lit(0), "tile_height": F.col("bitmap_height")})


def tile_tasks(pages: DataFrame) -> DataFrame:
    """One task for each tile, with all columns of pages."""
    return pages.where("bitmap_width > 0").join(ocr_tile_plan(pages), list(PAGE)).withColumn("pass", F.lit("tile"))


def evenly(tasks: DataFrame) -> DataFrame:
    """Tasks over as many partitions as the cluster has cores, or more: an engine's tasks are few bytes and much work, so
    partitions that Spark makes by size would leave it to a few cores."""
    n = max(tasks.sparkSession.sparkContext.defaultParallelism, int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return tasks.repartition(n, *PAGE, "tile_y")
