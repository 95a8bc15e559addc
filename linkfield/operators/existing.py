"""Candidates on spots that are linked already."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geometry import corners, same_spot
from .lines import PAGE

#: Links in one block at most, and the height in points of the strips by which a page's links are put in order.
BLOCK_LINKS, STRIP = 64, 36.0


def existing_links(annotations: DataFrame) -> DataFrame:
    """Boxes of link annotations, whatever their action; other kinds of annotations don't count."""
    return annotations.where(F.col("subtype") == "Link").select(*PAGE, "left_pt", "bottom_pt", "width_pt", "height_pt")


def link_blocks(existing: DataFrame, most: int = BLOCK_LINKS) -> DataFrame:
    """A page's links in blocks of neighbours, with the box around each: tall links first, since they would widen other
    blocks, then by strip and from left to right.  Links without area, which match nothing, are left out.

    A page of up to `most` links is one block; a crowded one has more blocks, not a longer array."""
    boxes = existing.where("width_pt > 0 and height_pt > 0").select(*PAGE, corners().alias("box"))
    tall = (F.col("box.y1") - F.col("box.y0")) > STRIP
    near = Window.partitionBy(*PAGE).orderBy(F.desc(tall), F.floor(F.col("box.y0") / STRIP), "box")
    blocks = boxes.withColumn("block", F.floor((F.row_number().over(near) - 1) / most)).groupBy(*PAGE, "block")
    around = [F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1")]
    return blocks.agg(F.collect_list("box").alias("links"), *around)


def split_existing(candidates: DataFrame, existing: DataFrame, most: int = BLOCK_LINKS, stored_by_page: bool = False) -> DataFrame:
    """candidates with status: already_linked if one overlaps some existing link of its page by more than half of the
    smaller box, else linked.

    An existence join by page: a candidate meets the blocks whose box it touches, each link once, and stops at the first
    that matches.  Candidates are dealt by page up front, as the join needs them; else Spark moves the test for existence
    into the branches of a union, where it can't be planned.  Candidates that are read from a table with buckets by page
    (stored_by_page) stay where they are; with links from such a table nothing is shuffled."""
    dealt = candidates if stored_by_page else candidates.repartition(*PAGE)
    rows, blocks = dealt.withColumn("__box", corners()).alias("__c"), link_blocks(existing, most).alias("__b")
    mine, of = lambda c: F.col(f"__c.{c}").outer(), lambda c: F.col(f"__b.{c}")
    here = (of("doc_id") == mine("doc_id")) & (of("page_number") == mine("page_number"))
    touches = (of("x0") < mine("__box.x1")) & (of("x1") > mine("__box.x0")) & (of("y0") < mine("__box.y1")) & (of("y1") > mine("__box.y0"))
    already = blocks.where(here & touches & F.exists(of("links"), lambda e: same_spot(mine("__box"), e))).exists()
    return rows.withColumn("status", F.when(already, "already_linked").otherwise("linked")).drop("__box")
