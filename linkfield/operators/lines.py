"""Lines from positioned chunks of text.

Chunks have doc_id, page_number, an order (source_rank, tile_y, seq), text, a box in points and space_width.  All
windows are over (doc_id, page_number): one shuffle brings a page together, and grouping by line needs no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import corners
from ..functions.text import is_blank

PAGE = ("doc_id", "page_number")
ORDER = ("source_rank", "tile_y", "seq")

#: Bits that tell which pages may have a URL: blocks of sixteen words of 64 bits, 4 MiB at most.
BLOCKS, WORDS = 1 << 15, 16

#: Column of chunks that tells whether they have a URL's mark or may have a piece of one.
MARKED = "__marked"

#: Tasks that all chunks are dealt to, for each partition of a shuffle (or core, if there are more).
TASKS = 4


def dealt_by_page(chunks: DataFrame) -> DataFrame:
    """chunks by page over a number of tasks that Spark leaves as it is.  It joins the partitions of a shuffle down to one
    a core, up to 64 MB as they were sent, and a task that lines them sorts all of its own in memory, over ten times that."""
    session = chunks.sparkSession
    return chunks.repartition(TASKS * max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), *PAGE)


def drop_blank_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with more than white space; their text stays as it is.  Null text is blank."""
    return chunks.where(~is_blank(F.coalesce("text", F.lit(""))))


def group_lines(chunks: DataFrame) -> DataFrame:
    """chunks with line_no: a new line begins where a chunk's bottom is half the taller one's height or more away from
    the chunk just before it.  The order of content is trusted; nothing is sorted by place."""
    page = Window.partitionBy(*PAGE).orderBy(*ORDER)
    away = F.abs(F.col("bottom_pt") - F.lag("bottom_pt").over(page)) >= F.lit(0.5) * F.greatest(F.col("height_pt"), F.lag("height_pt").over(page))
    breaks = F.coalesce(away, F.lit(False)).cast("int")
    return chunks.withColumn("__break", breaks).withColumn("line_no", F.sum("__break").over(page).cast("int")).drop("__break")


def line_spans(chunks: DataFrame) -> DataFrame:
    """Lined chunks with piece (the text, after a space where the gap to the chunk before is wider than half its
    space) and start_off, end_off of the text within the line."""
    line = Window.partitionBy(*PAGE, "line_no").orderBy(*ORDER)
    gap = F.col("left_pt") - F.lag(F.col("left_pt") + F.col("width_pt")).over(line)
    space = F.when(gap > F.lag("space_width").over(line) / 2, " ").otherwise("")
    out = chunks.withColumn("piece", F.concat(space, "text"))
    end = F.sum(F.length("piece")).over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return out.withColumn("end_off", end).withColumn("start_off", F.col("end_off") - F.length("text"))


def reconstruct_lines(spans: DataFrame) -> DataFrame:
    """One row per line: line_text, source_rank (of its first chunk) and spans (places and corners of its chunks)."""
    one = F.struct(*ORDER, "piece", "start_off", "end_off", corners().alias("box"))
    lines = spans.groupBy(*PAGE, "line_no").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    return lines.select(*PAGE, "line_no", F.array_join(F.col("spans")["piece"], "").alias("line_text"), F.col("spans")[0]["source_rank"].alias("source_rank"), "spans")


def lines_of(chunks: DataFrame) -> DataFrame:
    """Chunks to lines.  Where chunks say whether they are marked (see pages_with_marks), lines without a marked one go
    before their chunks are put together; the others keep their numbers."""
    lined = group_lines(drop_blank_chunks(chunks))
    if MARKED in chunks.columns:
        lined = lined.withColumn(MARKED, F.max(MARKED).over(Window.partitionBy(*PAGE, "line_no").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where(MARKED).drop(MARKED)
    return reconstruct_lines(line_spans(lined))


def lines_by_pass(lines: DataFrame) -> DataFrame:
    """Lines of real text (rank 0), the whole-page pass (1) and tiles (2) with what each is a line of: alone (the whole
    pass by itself), without_tiles, with_tiles.

    Ranks follow one another on a page, so any of the three has the lines of all chunks, less those chunks that it lacks.
    Most lines are of one rank and stay as they are; one that runs from a rank into the next is there once for each of
    the three that has some of it, its text without the space that came before."""
    first, last, part = F.col("spans")[0]["source_rank"], F.element_at("spans", -1)["source_rank"], lambda low, high: F.filter("spans", lambda s: s["source_rank"].between(low, high))
    uses = lambda spans, *which: F.struct(spans.alias("spans"), *[w.alias(n) for n, w in zip(("alone", "without_tiles", "with_tiles"), which, strict=True)])
    yes, no = F.lit(True), F.lit(False)
    whole = F.array(uses(F.col("spans"), first == 1, first < 2, yes))
    parts = F.array(uses(part(1, 1), yes, no, no), uses(part(0, 1), no, yes, no), uses(F.col("spans"), no, no, yes))
    each = lines.select(*PAGE, "line_no", "line_text", F.explode(F.when(first == last, whole).otherwise(F.filter(parts, lambda p: F.size(p["spans"]) > 0))).alias("__p"))
    each = each.select(*PAGE, "line_no", "line_text", "__p.*").withColumn("__from", F.col("spans")[0]["start_off"])
    moved = F.transform("spans", lambda s: s.withField("start_off", s["start_off"] - F.col("__from")).withField("end_off", s["end_off"] - F.col("__from")))
    text = F.substring("line_text", F.col("__from") + 1, F.element_at("spans", -1)["end_off"] - F.col("__from"))
    return each.select(*PAGE, "line_no", text.alias("line_text"), F.col("spans")[0]["source_rank"].alias("source_rank"), F.when(F.col("__from") == 0, F.col("spans")).otherwise(moved).alias("spans"), "alone", "without_tiles", "with_tiles")


def computed_once(rows: DataFrame, *columns: str) -> DataFrame:
    """rows whose columns are values from here on.  Spark moves a column's expression into the ones that use it, and an
    expression over array elements would then compute it anew for each element; a generator stops that."""
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, F.explode(F.array(F.struct(*columns))).alias("__once")).select(*[F.col(f"__once.{c}") if c in columns else F.col(c) for c in rows.columns])


def _has_mark(text: Column, bare: bool) -> Column:
    found = text.contains("://") | (text.contains(".") & F.lower(text).contains("www."))
    return found | text.contains("/") if bare else found


def _has_part_of_mark(text: Column, bare: bool) -> Column:
    """Whether text has one of the marks, or its end, its beginning or all of it may be a piece of one."""
    ends = text.endswith("w") | text.endswith("W") | text.endswith(":") | text.endswith(":/")
    begins = text.startswith("/") | text.startswith(".") | (text.contains(".") & (text.startswith("w") | text.startswith("W")))
    return _has_mark(text, bare) | ends | begins


def of_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows of all given pages, and of a few others: pages are told by one bit of their hash, so what is broadcast stays
    within 4 MiB however many there are, and rows aren't shuffled."""
    code = F.xxhash64(*PAGE)
    block, word, bit = code.bitwiseAND(F.lit(BLOCKS - 1)), F.shiftrightunsigned(code, 15).bitwiseAND(F.lit(WORDS - 1)).cast("int"), F.shiftrightunsigned(code, 19).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bit"))
    coded = pages.select(block.alias("__block"), word.alias("__word"), bit.alias("__bit"))
    bits = coded.groupBy("__block").agg(F.array(*[F.bit_or(F.when(F.col("__word") == i, one).otherwise(F.lit(0).cast("long"))) for i in range(WORDS)]).alias("__bits"))
    return rows.join(F.broadcast(bits), (F.col("__block") == block) & (F.getbit(F.get("__bits", word), bit) == 1), "left_semi")


def pages_with_marks(chunks: DataFrame, bare: bool = True) -> DataFrame:
    """chunks of those pages whose lines have what any URL has: ://, www., or (bare) a slash; few others are among them.

    Chunks that have a mark or may be a piece of one are lined by themselves.  Pieces of a mark are neighbours without a
    space between them, so they are in these lines, too, where the mark is whole again.  Pages without any, most of a
    corpus, are neither shuffled nor lined.  The chunks say whether they are marked, so that lines_of can leave out lines of
    these pages that have no mark."""
    marked = _has_part_of_mark(F.col("text"), bare)
    some = chunks.where(marked)
    return of_pages(chunks, lines_of(some).where(_has_mark(F.col("line_text"), bare)).select(*PAGE)).withColumn(MARKED, F.coalesce(marked, F.lit(False)))
