"""The registered queries of the link operators, each over the whole derived tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import default_uri_filter, trim_trailing_punctuation
from ..operators.candidates import bare_domain_matches, candidate_uris, drop_bare_under_scheme, match_to_rect, scheme_url_matches
from ..operators.dedupe import dedupe_qr, dedupe_text_spots
from ..operators.detection import OCR_WORDS, OcrEngine, apply_ocr_engine, attach_page_size, ocr_tile_plan, ocr_words_to_chunks, pyramid_plan, qr_padded_box, tile_tasks, to_points
from ..operators.existing import existing_links, split_existing
from ..operators.lines import PAGE, dealt_by_page, drop_blank_chunks, group_lines, lines_of, pages_with_marks
from ..operators.report import compare_presets, document_summary, letter_findings, link_edges, link_messages, ordered_results, overlay_percent, page_trace_counts, pages_with_findings
from ..options import DEFAULT_SCALES, INTERACTIVE_SCALES, ScanOptions
from ..sources.files import classify_inputs, image_page_size, link_annotations, output_paths
from ..sources.shared import shared_dir
from . import incremental, jobs
from .derived import Tables

BOX = ("left_pt", "bottom_pt", "width_pt", "height_pt")


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, in which both engines agree."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _codes(t: Tables) -> DataFrame:
    return dedupe_qr(qr_padded_box(t.qr_detections, t.pages_dim))


def _scan(t: Tables) -> DataFrame:
    return jobs.scan(t.text_chunks, t.ocr_words, t.qr_detections, t.pages_dim, t.annotations)


def _found_text(t: Tables) -> DataFrame:
    return jobs.text_candidates(t.text_chunks)


def _matches(lines: DataFrame, name: str) -> DataFrame:
    return lines.select(*PAGE, "line_no", F.explode(name).alias("m")).select(*PAGE, "line_no", "m.*")


def s1_classify_inputs(t: Tables) -> DataFrame:
    return classify_inputs(t.paths).select("doc_id", "path", "kind")


def s2_output_paths(t: Tables) -> DataFrame:
    return output_paths(t.paths).select("doc_id", "path", "output")


def s3_link_annotations(t: Tables) -> DataFrame:
    return _rounded(link_annotations(_scan(t)).withColumn("border", F.array_join("border", " ")))


def s4_existing_links(t: Tables) -> DataFrame:
    return existing_links(t.annotations)


def p1_drop_blank_chunks(t: Tables) -> DataFrame:
    return drop_blank_chunks(t.text_chunks).select(*PAGE, "seq", "text")


def p2_default_uri_filter(t: Tables) -> DataFrame:
    words = t.text_chunks.select(*PAGE, "seq", "text").unionByName(t.qr_detections.select(*PAGE, (F.lit(-1) - F.col("level_no")).alias("seq"), F.col("payload").alias("text")))
    return words.withColumn("uri", default_uri_filter(F.col("text"))).where("uri is not null")


def tagged(text: Column) -> Column:
    """The default filter's targets with a tag, the custom filter of the tests."""
    return F.concat(default_uri_filter(text), F.lit("?utm_source=qr"))


def p3_custom_uri_filter(t: Tables) -> DataFrame:
    lines = drop_bare_under_scheme(bare_domain_matches(scheme_url_matches(lines_of(pages_with_marks(t.text_chunks)))))
    text = candidate_uris(lines, tagged).select(*PAGE, F.lit("text").alias("source"), "line_no", "is_bare", "match_no", "uri")
    codes = _codes(t).withColumn("uri", tagged(F.col("payload"))).where("uri is not null")
    return text.unionByName(codes.select(*PAGE, F.lit("qr").alias("source"), F.col("level_no").alias("line_no"), F.col("inverted").cast("int").alias("is_bare"), F.col("decode_no").alias("match_no"), "uri"))


def p4_pixel_box_to_points(t: Tables) -> DataFrame:
    return _rounded(to_points(t.ocr_words, t.pages_dim).select(*PAGE, "seq", *BOX))


def p5_qr_padded_box(t: Tables) -> DataFrame:
    return qr_padded_box(t.qr_detections, t.pages_dim)


def p6_pyramid_plan(t: Tables) -> DataFrame:
    return _rounded(pyramid_plan(t.pages_dim, DEFAULT_SCALES))


def p7_ocr_tile_plan(t: Tables) -> DataFrame:
    return ocr_tile_plan(t.pages_dim)


def p8_ocr_words_to_chunks(t: Tables) -> DataFrame:
    return _rounded(ocr_words_to_chunks(t.ocr_words, t.pages_dim))


def p9_image_page_size(t: Tables) -> DataFrame:
    return _rounded(image_page_size(classify_inputs(t.paths).where("kind = 'image'")).select("doc_id", "page_width_pt", "page_height_pt"))


def p10_link_edges(t: Tables) -> DataFrame:
    return _rounded(link_edges(_scan(t), t.pages_dim).select(*PAGE, "source", "order_key", "right_pt", "top_pt", "inside"))


def p11_overlay_percent(t: Tables) -> DataFrame:
    return _rounded(overlay_percent(_scan(t), t.pages_dim).select(*PAGE, "source", "order_key", "left_pc", "top_pc", "width_pc", "height_pc"))


def t1_group_lines(t: Tables) -> DataFrame:
    return group_lines(dealt_by_page(drop_blank_chunks(t.text_chunks))).select(*PAGE, "seq", "line_no")


def t2_reconstruct_lines(t: Tables) -> DataFrame:
    lines = lines_of(dealt_by_page(t.text_chunks))
    return lines.select(*PAGE, "line_no", "line_text", F.aggregate("spans", F.lit(0), lambda n, s: n + s["start_off"]).cast("long").alias("sum_starts"), F.size("spans").alias("n_chunks"))


def t3_scheme_url_matches(t: Tables) -> DataFrame:
    return _matches(scheme_url_matches(lines_of(pages_with_marks(t.text_chunks, bare=False))), "scheme")


def t4_bare_domain_matches(t: Tables) -> DataFrame:
    return _matches(bare_domain_matches(lines_of(pages_with_marks(t.text_chunks))), "bare")


def t5_drop_bare_under_scheme(t: Tables) -> DataFrame:
    return _matches(drop_bare_under_scheme(bare_domain_matches(scheme_url_matches(lines_of(pages_with_marks(t.text_chunks))))), "bare")


def t6_trim_trailing_punctuation(t: Tables) -> DataFrame:
    return t.text_chunks.select(*PAGE, "seq", trim_trailing_punctuation(F.col("text")).alias("trimmed"))


def _candidates(t: Tables) -> DataFrame:
    return candidate_uris(drop_bare_under_scheme(bare_domain_matches(scheme_url_matches(lines_of(pages_with_marks(t.text_chunks))))))


def t7_candidate_uris(t: Tables) -> DataFrame:
    return _candidates(t).select(*PAGE, "line_no", "is_bare", "match_no", "candidate", "uri")


def t8_match_to_rect(t: Tables) -> DataFrame:
    return match_to_rect(_candidates(t))


def j1_split_existing(t: Tables) -> DataFrame:
    return split_existing(_found_text(t), existing_links(t.annotations)).select(*PAGE, "line_no", "match_no", "uri", "status")


def j2_ocr_escalation_pages(t: Tables) -> DataFrame:
    return jobs.ocr_escalation_pages(t.ocr_words, t.pages_dim).select(*PAGE)


def j3_attach_page_size(t: Tables) -> DataFrame:
    return attach_page_size(t.ocr_words, t.pages_dim).select(*PAGE, "seq", "text", "page_width_pt", "page_height_pt", "bitmap_width", "bitmap_height")


def j4_compare_presets(t: Tables) -> DataFrame:
    hits = t.qr_detections
    of = lambda scales: dedupe_qr(qr_padded_box(hits.where(F.col("scale").isin(*scales)), t.pages_dim))
    return compare_presets(of(DEFAULT_SCALES), of(INTERACTIVE_SCALES))


def d1_dedupe_qr(t: Tables) -> DataFrame:
    return _codes(t)


def d2_dedupe_text_spots(t: Tables) -> DataFrame:
    return dedupe_text_spots(_found_text(t))


def a1_document_summary(t: Tables) -> DataFrame:
    return document_summary(t.pages.select(F.col("page_id").alias("doc_id")), _scan(t))


def a1_link_messages(t: Tables) -> DataFrame:
    return link_messages(_scan(t))


def a2_pages_with_findings(t: Tables) -> DataFrame:
    return pages_with_findings(_scan(t))


def a3_page_trace_counts(t: Tables) -> DataFrame:
    return page_trace_counts(_codes(t), _scan(t))


def a4_debug_candidates(t: Tables) -> DataFrame:
    return _codes(t).withColumn("accepted", default_uri_filter(F.col("payload")).isNotNull())


def w1_letter_findings(t: Tables) -> DataFrame:
    return letter_findings(_scan(t)).select(*PAGE, "source", "order_key", "status", "letter")


def o1_ordered_results(t: Tables) -> DataFrame:
    return ordered_results(_scan(t)).select(*PAGE, "source", "uri", "result_no")


def u1_merge_sources(t: Tables) -> DataFrame:
    both = jobs.merge_sources(jobs.scan_qr(t.qr_detections, t.pages_dim, t.annotations), jobs.scan_text(t.text_chunks, t.annotations))
    return _rounded(both)


def u2_merge_chunks(t: Tables) -> DataFrame:
    return _rounded(jobs.merge_chunks(t.text_chunks, jobs.ocr_chunks(t.ocr_words, t.pages_dim)))


def u3_merge_status(t: Tables) -> DataFrame:
    found = _scan(t).select(*PAGE, "source", "order_key", "uri", "status")
    return jobs.merge_status(found.where("status = 'linked'").drop("status"), found.where("status <> 'linked'").drop("status"))


def x1_scan_text(t: Tables) -> DataFrame:
    return jobs.scan_text(t.text_chunks, t.annotations)


def x2_scan_qr(t: Tables) -> DataFrame:
    return _rounded(jobs.scan_qr(t.qr_detections, t.pages_dim, t.annotations))


def x3_scan(t: Tables) -> DataFrame:
    return _rounded(_scan(t))


def x4_link(t: Tables) -> DataFrame:
    rows = jobs.link(t.text_chunks, t.ocr_words, t.qr_detections, t.pages_dim, t.annotations)
    return _rounded(rows.drop("border"))


def x5_relink(t: Tables) -> DataFrame:
    return _rounded(jobs.relink(t.text_chunks, t.ocr_words, t.qr_detections, t.pages_dim, t.annotations).select(*PAGE, "source", "order_key", "uri", "status"))


def open_reader() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Reads tasks by the words that are known of their page, at their places there: a whole page shows all but faint
    ones, a tile those that lie in it."""
    columns = [f.split()[0] for f in OCR_WORDS.split(", ")]

    def read(tasks: pd.DataFrame) -> pd.DataFrame:
        rows = tasks.drop(columns=["seq", "text"], errors="ignore").explode("words").dropna(subset="words").reset_index(drop=True)
        words = pd.DataFrame(rows["words"].tolist(), columns=["seq", "text", "px_left", "px_top", "px_right", "px_bottom", "faint"])
        out = pd.concat([rows.drop(columns="words"), words], axis=1)
        inside = (out["px_top"] >= out["tile_y"]) & (out["px_bottom"] <= out["tile_y"] + out["tile_height"])
        out = out[inside & ((out["pass"] == "tile") | ~out["faint"].astype(bool))]
        return out.assign(px_top=out["px_top"] - out["tile_y"], px_bottom=out["px_bottom"] - out["tile_y"])[columns]

    return read


def _pages_with_words(t: Tables) -> DataFrame:
    """Pages with the words of their bitmap; those that only a tile shows are faint."""
    top = lambda c: (F.col(c) + F.col("tile_y")).alias(c)
    word = F.struct("seq", "text", "px_left", top("px_top"), "px_right", top("px_bottom"), (F.col("pass") == "tile").alias("faint"))
    return t.pages_dim.join(t.ocr_words.groupBy(*PAGE).agg(F.collect_list(word).alias("words")), list(PAGE), "left")


def e1_apply_ocr_engine(t: Tables) -> DataFrame:
    plain = _pages_with_words(t).withColumn("words", F.filter("words", lambda w: ~w["faint"]))
    return apply_ocr_engine(tile_tasks(plain), OcrEngine("known words", open_reader))


def x3_scan_with_engine(t: Tables) -> DataFrame:
    options = ScanOptions(ocr_engine=OcrEngine("known words", open_reader))
    return _rounded(jobs.scan(t.text_chunks, None, t.qr_detections, _pages_with_words(t), t.annotations, options))


def edited(chunks: DataFrame) -> DataFrame:
    """The pages that an edit changes, as they are after it."""
    return chunks.where("page_number = 99 and doc_id % 10 = 0").withColumn("text", F.replace("text", F.lit("wiki"), F.lit("en/page")))


def x5_incremental_relink(t: Tables) -> DataFrame:
    """All chunks as one batch, edited pages as the next; links after both, the second run having read the second alone."""
    folder = f"{shared_dir(t.spark)}/incremental-{uuid.uuid4().hex}"
    t.text_chunks.write.parquet(f"{folder}/in/batch=0")
    incremental.scan_changes(t.spark, f"{folder}/in", f"{folder}/state")
    edited(t.spark.read.parquet(f"{folder}/in/batch=0")).write.parquet(f"{folder}/in/batch=1")
    return incremental.relink_changes(t.spark, f"{folder}/in", f"{folder}/state", t.annotations)


_ALL = (
    s1_classify_inputs, s2_output_paths, s3_link_annotations, s4_existing_links, p1_drop_blank_chunks, p2_default_uri_filter, p3_custom_uri_filter, p4_pixel_box_to_points,
    p5_qr_padded_box, p6_pyramid_plan, p7_ocr_tile_plan, p8_ocr_words_to_chunks, p9_image_page_size, p10_link_edges, p11_overlay_percent, t1_group_lines, t2_reconstruct_lines,
    t3_scheme_url_matches, t4_bare_domain_matches, t5_drop_bare_under_scheme, t6_trim_trailing_punctuation, t7_candidate_uris, t8_match_to_rect, j1_split_existing,
    j2_ocr_escalation_pages, j3_attach_page_size, j4_compare_presets, d1_dedupe_qr, d2_dedupe_text_spots, a1_document_summary, a1_link_messages, a2_pages_with_findings, a3_page_trace_counts,
    a4_debug_candidates, w1_letter_findings, o1_ordered_results, u1_merge_sources, u2_merge_chunks, u3_merge_status, x1_scan_text, x2_scan_qr, x3_scan, x3_scan_with_engine, x4_link, x5_relink, x5_incremental_relink, e1_apply_ocr_engine,
)


def _query(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _query(f) for f in _ALL}
