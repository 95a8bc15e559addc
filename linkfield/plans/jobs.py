"""Whole jobs: tables of chunks, words, codes and annotations in, links out.

Links have doc_id, page_number, source (qr or text), source_rank, order_key, uri, a box in points, and status.
Everything is keyed by page; only reports work by document, over links.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Window, functions as F

from ..functions.text import default_uri_filter
from ..operators.candidates import bare_domain_matches, candidate_uris, drop_bare_under_scheme, match_to_rect, scheme_url_matches
from ..operators.dedupe import dedupe_qr, dedupe_text_spots
from ..operators.detection import OcrEngine, apply_ocr_engine, evenly, ocr_words_to_chunks, pyramid_plan, qr_padded_box, rendered_sizes, tile_tasks, to_points, whole_page_tasks
from ..operators.existing import existing_links, split_existing
from ..operators.lines import PAGE, lines_by_pass, lines_of, pages_with_marks
from ..options import DEFAULT, ScanOptions
from ..sources.files import link_annotations
from ..sources.shared import written

@dataclass(frozen=True)
class Trace:
    """What a scan counts while it runs, without a plan of its own: unique codes before the filter, and links by source
    and status.  totals waits for the scan's first action."""

    codes: Observation = field(default_factory=lambda: Observation("codes"))
    links: Observation = field(default_factory=lambda: Observation("links"))

    @property
    def totals(self) -> dict[str, int]:
        return {**self.codes.get, **self.links.get}


LOCATED = ("doc_id", "page_number", "source", "source_rank", "order_key", "uri", "left_pt", "bottom_pt", "width_pt", "height_pt")


PASSES = ("alone", "without_tiles", "with_tiles")


def _likely(lines: DataFrame, options: ScanOptions) -> DataFrame:
    """Lines that have the few letters that any match has."""
    low = F.lower("line_text")
    likely = low.contains("http") | low.contains("www.")
    return lines.where(likely | F.col("line_text").contains("/") if options.match_bare_domains else likely)


def _candidates(lines: DataFrame, options: ScanOptions, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines without the few letters that any match has go first, so only others have their arrays worked on."""
    some = scheme_url_matches(_likely(lines, options))
    apart = drop_bare_under_scheme(bare_domain_matches(some, options.match_bare_domains, options.tlds))
    return match_to_rect(candidate_uris(apart, options.uri_filter, keep), keep)


def text_candidates(chunks: DataFrame, options: ScanOptions = DEFAULT) -> DataFrame:
    """Every URL in the chunks' lines with its box, before dedup.  Only pages that may have one are lined."""
    return _candidates(lines_of(pages_with_marks(chunks, options.match_bare_domains)), options)


def candidates_of_passes(chunks: DataFrame, options: ScanOptions = DEFAULT) -> DataFrame:
    """text_candidates of merged chunks (real ones of rank 0, the whole-page pass, tiles), without tiles on pages whose
    whole-page pass alone has a URL.

    Lines are matched once: the pass's own URLs, which decide, are among those of all lines, and a window over the page's
    candidates sees them where they are."""
    found = F.max("alone").over(Window.partitionBy(*PAGE))
    every = _candidates(lines_by_pass(_likely(lines_of(pages_with_marks(chunks, options.match_bare_domains)), options)), options, PASSES).withColumn("__found", found)
    return every.where((F.col("__found") & F.col("without_tiles")) | (~F.col("__found") & F.col("with_tiles"))).drop("__found", *PASSES)


def _one_per_spot(candidates: DataFrame) -> DataFrame:
    order = F.col("line_no").cast("long") * 1_000_000 + F.col("is_bare") * 500_000 + F.col("match_no")
    return dedupe_text_spots(candidates).withColumns({"source": F.lit("text"), "source_rank": F.lit(1), "order_key": order}).select(*LOCATED)


def located_text(chunks: DataFrame, options: ScanOptions = DEFAULT) -> DataFrame:
    """Text links with their boxes, one per spot; the same whether spots are linked already or not."""
    return _one_per_spot(text_candidates(chunks, options))


def located_qr(detections: DataFrame, pages: DataFrame, options: ScanOptions = DEFAULT, trace: Trace | None = None) -> DataFrame:
    """Code links with their boxes: hits of the options' levels merge by payload and spot, then targets are filtered."""
    codes = dedupe_qr(qr_padded_box(detections.where(F.col("scale").isin(*options.scales)), pages, sizes=True))
    if trace is not None:
        codes = codes.observe(trace.codes, F.count(F.lit(1)).alias("n_codes"), F.count_if(default_uri_filter(F.col("payload")).isNull()).alias("n_no_uri"))
    accepted = codes.withColumn("uri", (options.uri_filter or default_uri_filter)(F.col("payload"))).where("uri is not null")
    order = F.col("level_no").cast("long") * 1_000_000 + F.col("inverted").cast("int") * 500_000 + F.col("decode_no")
    return to_points(accepted).withColumns({"source": F.lit("qr"), "source_rank": F.lit(0), "order_key": order}).select(*LOCATED)


def scan_text(chunks: DataFrame, annotations: DataFrame, options: ScanOptions = DEFAULT) -> DataFrame:
    """Links from text: dedup by spot first, then what is linked already."""
    return split_existing(located_text(chunks, options), existing_links(annotations))


def scan_qr(detections: DataFrame, pages: DataFrame, annotations: DataFrame, options: ScanOptions = DEFAULT) -> DataFrame:
    """Links from codes."""
    return split_existing(located_qr(detections, pages, options), existing_links(annotations))


def merge_sources(qr: DataFrame, text: DataFrame) -> DataFrame:
    """Links of both sources; a code and a text are never taken for one another."""
    return qr.unionByName(text)


def merge_chunks(real: DataFrame, ocr: DataFrame) -> DataFrame:
    """Real chunks and OCR's, always both; source_rank keeps real text first."""
    return real.unionByName(ocr)


def merge_status(linked: DataFrame, already: DataFrame) -> DataFrame:
    """New and already linked findings as one table."""
    return linked.withColumn("status", F.lit("linked")).unionByName(already.withColumn("status", F.lit("already_linked")))


def ocr_escalation_pages(words: DataFrame, pages: DataFrame, options: ScanOptions = DEFAULT) -> DataFrame:
    """Pages whose whole-page OCR alone has no URL, linked or not: only these pay for the tile pass."""
    whole = ocr_words_to_chunks(words.where("pass = 'whole'"), pages)
    return pages.join(_candidates(lines_of(whole), options).select(*PAGE).distinct(), list(PAGE), "left_anti")


def ocr_chunks(words: DataFrame, pages: DataFrame, options: ScanOptions = DEFAULT) -> DataFrame:
    """Chunks of the whole-page pass, and of the tile pass on pages that escalate."""
    chunks = ocr_words_to_chunks(words.where("pass IN ('whole', 'tile')"), pages)
    found = text_candidates(chunks.where("source_rank = 1"), options).select(*PAGE).distinct().withColumn("__found", F.lit(True))
    return chunks.join(found, list(PAGE), "left").where("source_rank = 1 OR __found IS NULL").drop("__found")


def detector_tasks(pages: DataFrame, options: ScanOptions = DEFAULT) -> DataFrame:
    """What a code detector is to look at: every page rendered at the options' dpi, at each of their levels."""
    return pyramid_plan(rendered_sizes(pages, options.dpi), options.scales)


def read_words(pages: DataFrame, engine: OcrEngine, options: ScanOptions = DEFAULT) -> DataFrame:
    """OCR words of an engine: every page as a whole, and the tiles of those pages whose whole pass has no URL.

    pages may have more columns (a path, say), which go with the engine's tasks.  What the engine reads is written before
    anything else looks at it: it is read once, for the probe and the scan, whatever executors are lost later."""
    whole = written(apply_ocr_engine(evenly(whole_page_tasks(pages)), engine), "words-whole")
    again = pages.join(ocr_escalation_pages(whole, pages, options).select(*PAGE), list(PAGE), "left_semi")
    return whole.unionByName(written(apply_ocr_engine(evenly(tile_tasks(again)), engine), "words-tiles"))


def located(chunks: DataFrame, words: DataFrame | None, detections: DataFrame, pages: DataFrame, options: ScanOptions = DEFAULT, trace: Trace | None = None) -> DataFrame:
    """Links of all sources with their boxes; words are finished ones or those of the options' engine."""
    if options.ocr_engine is not None:
        if words is not None:
            raise ValueError("give finished words or an engine, not both")
        read = read_words(pages, options.ocr_engine, options)  # tiles of other pages weren't read
        text = text_candidates(merge_chunks(chunks, ocr_words_to_chunks(read, pages)), options)
    elif words is None:
        text = text_candidates(chunks, options)
    else:
        text = candidates_of_passes(merge_chunks(chunks, ocr_words_to_chunks(words.where("pass IN ('whole', 'tile')"), pages)), options)
    return merge_sources(located_qr(detections, pages, options, trace), _one_per_spot(text))


def scan(chunks: DataFrame, words: DataFrame | None, detections: DataFrame, pages: DataFrame, annotations: DataFrame, options: ScanOptions = DEFAULT, trace: Trace | None = None) -> DataFrame:
    """All links of all pages, with status; nothing is changed.  words are finished OCR words; with an engine in the
    options they are None, and the engine runs first, while this is called.  A trace counts along."""
    links = split_existing(located(chunks, words, detections, pages, options, trace), existing_links(annotations))
    if trace is None:
        return links
    of = lambda source, status: F.count_if((F.col("source") == source) & (F.col("status") == status))
    return links.observe(trace.links, of("text", "linked").alias("n_text"), of("text", "already_linked").alias("n_text_already"), of("qr", "linked").alias("n_qr"), of("qr", "already_linked").alias("n_qr_already"))


def link(chunks: DataFrame, words: DataFrame | None, detections: DataFrame, pages: DataFrame, annotations: DataFrame, options: ScanOptions = DEFAULT) -> DataFrame:
    """The annotation rows that the scan's new links become."""
    return link_annotations(scan(chunks, words, detections, pages, annotations, options))


def relink(chunks: DataFrame, words: DataFrame | None, detections: DataFrame, pages: DataFrame, annotations: DataFrame, options: ScanOptions = DEFAULT) -> DataFrame:
    """The scan after its own new links have been added: all of them are linked already, but boxes without area.

    Where links are does not depend on annotations, so they are located once, written, and judged twice."""
    found, before = written(located(chunks, words, detections, pages, options), "located"), existing_links(annotations)
    added = split_existing(found, before).where("status = 'linked'").select(*before.columns)
    return split_existing(found, before.unionByName(added))
