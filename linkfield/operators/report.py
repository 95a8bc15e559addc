"""Reports over found links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import written

#: Pages whose counts are summed up together.
PAGES_TOGETHER = 1000

# What is said of a link, by status.
LINKING, LEFT_ALONE = "linking to ", " is already linked, left alone"


def numbered(links: DataFrame, name: str, parts: Sequence[Column], within: Sequence[Column | str]) -> DataFrame:
    """links with name: their number in the document, from 1, by parts (of equal parts, by page) and within a part's page.

    A document is never brought together: rows are ranked within their part and page, and to that comes the count of what
    stands before, from sums over blocks of pages.  links are written first, since counts and ranks both read them; there
    are far fewer of them than of what they are made from."""
    keys = [f"__p{k}" for k in range(len(parts))]
    unit = ["doc_id", *keys, "page_number"]
    rows = written(links.withColumns(dict(zip(keys, parts, strict=True))), "links").repartition(*unit)
    block = F.floor(F.col("page_number") / PAGES_TOGETHER)
    counts = rows.groupBy(*unit).agg(F.count("*").alias("__n")).withColumn("__block", block)
    blocks = counts.groupBy("doc_id", *keys, "__block").agg(F.sum("__n").alias("__all"))
    up_to_here = (Window.unboundedPreceding, -1)
    before_block = F.coalesce(F.sum("__all").over(Window.partitionBy("doc_id").orderBy(*keys, "__block").rowsBetween(*up_to_here)), F.lit(0))
    before_page = F.coalesce(F.sum("__n").over(Window.partitionBy("doc_id", *keys, "__block").orderBy("page_number").rowsBetween(*up_to_here)), F.lit(0))
    of_block = blocks.select("doc_id", *keys, "__block", before_block.alias("__before"))
    same = lambda a, b, on: [a[c].eqNullSafe(b[c]) for c in on]
    counted = counts.withColumn("__page", before_page)
    at = counted.join(of_block, same(counted, of_block, ["doc_id", *keys, "__block"])).select(*[counted[c].alias(f"__of_{c}") for c in unit], (F.col("__page") + F.col("__before")).alias("__at"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*unit).orderBy(*within)))
    out = ranked.join(at, [ranked[c].eqNullSafe(at[f"__of_{c}"]) for c in unit])
    return out.select(*links.columns, (F.col("__at") + F.col("__rank")).cast("int").alias(name))


def _new_first() -> Column:
    return F.when(F.col("status") == "linked", 0).otherwise(1)


def document_summary(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Per document: n_linked, n_already and a message; documents without findings count too."""
    n = links.groupBy("doc_id").agg(F.count_if(F.col("status") == "linked").alias("n_linked"), F.count_if(F.col("status") == "already_linked").alias("n_already"))
    out = documents.select("doc_id").distinct().join(n, "doc_id", "left").na.fill(0, ["n_linked", "n_already"])
    added = F.concat(F.col("n_linked").cast("string"), F.when(F.col("n_linked") == 1, " link added").otherwise(" links added"))
    message = F.when((F.col("n_linked") == 0) & (F.col("n_already") == 0), "nothing found").otherwise(added)
    return out.withColumn("message", message)


def pages_with_findings(links: DataFrame) -> DataFrame:
    return links.select("doc_id", "page_number").distinct()


def page_trace_counts(codes: DataFrame, links: DataFrame) -> DataFrame:
    """Per page: n_codes (unique codes, before the filter) and n_text (text links that are new)."""
    found = codes.groupBy("doc_id", "page_number").agg(F.count("*").alias("n_codes"))
    text = links.where("source = 'text' and status = 'linked'").groupBy("doc_id", "page_number").agg(F.count("*").alias("n_text"))
    return found.join(text, ["doc_id", "page_number"], "full").na.fill(0, ["n_codes", "n_text"])


def letter_findings(links: DataFrame) -> DataFrame:
    """links with letter: A, B, ... over a document, by page, then from the top; linked ones before others on a spot.
    Letters go on in code points after Z, as 16-bit numbers."""
    rows = numbered(links, "__number", [], [F.desc("bottom_pt"), _new_first(), "source_rank", "order_key"])
    code = F.hex(F.pmod(F.lit(64) + F.col("__number"), F.lit(1 << 16)).cast("long"))
    return rows.withColumn("letter", F.decode(F.unhex(F.lpad(code, 4, "0")), "UTF-16BE")).drop("__number")


def link_messages(links: DataFrame) -> DataFrame:
    """One line per finding: doc_id, message_no, page_number, message; a document's new links first, then those that
    are left alone, each in result order."""
    rows = numbered(links, "message_no", [_new_first(), F.col("source_rank")], ["order_key"])
    page = F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(": "))
    new, old = F.concat(page, F.lit(LINKING), F.col("uri")), F.concat(page, F.col("uri"), F.lit(LEFT_ALONE))
    return rows.select("doc_id", "message_no", "page_number", F.when(F.col("status") == "linked", new).otherwise(old).alias("message"))


def ordered_results(links: DataFrame) -> DataFrame:
    """links with result_no: codes by page, then text by page, each in the order of detection."""
    return numbered(links, "result_no", [F.col("source_rank")], ["order_key"])


def compare_presets(found_a: DataFrame, found_b: DataFrame) -> DataFrame:
    """Per document: n_a, n_b, and whether b finds at least as many links as a."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    both = n(found_a, "n_a").join(n(found_b, "n_b"), "doc_id", "full").na.fill(0, ["n_a", "n_b"])
    return both.withColumn("no_worse", F.col("n_b") >= F.col("n_a"))


def link_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links with right_pt, top_pt and whether they lie inside their page."""
    out = links.join(pages.select("doc_id", "page_number", "page_width_pt", "page_height_pt"), ["doc_id", "page_number"])
    out = out.withColumns({"right_pt": F.col("left_pt") + F.col("width_pt"), "top_pt": F.col("bottom_pt") + F.col("height_pt")})
    inside = (F.col("left_pt") >= 0) & (F.col("bottom_pt") >= 0) & (F.col("right_pt") <= F.col("page_width_pt")) & (F.col("top_pt") <= F.col("page_height_pt"))
    return out.withColumn("inside", inside)


def overlay_percent(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes in percent of their page, origin at the top left."""
    out = links.join(pages.select("doc_id", "page_number", "page_width_pt", "page_height_pt"), ["doc_id", "page_number"])
    w, h = F.col("page_width_pt"), F.col("page_height_pt")
    return out.withColumns({"left_pc": 100 * F.col("left_pt") / w, "top_pc": 100 * (h - F.col("bottom_pt") - F.col("height_pt")) / h, "width_pc": 100 * F.col("width_pt") / w, "height_pc": 100 * F.col("height_pt") / h})
