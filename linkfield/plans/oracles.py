"""DuckDB SQL for the queries of the link operators, built from shared table expressions."""

from __future__ import annotations

import re

from ..functions.text import ABSOLUTE_URI, BARE_URL, SCHEME_URL, SPACE, TLDS, WEB_SCHEME, WEB_URI
from ..operators.report import LEFT_ALONE, LINKING
from ..options import DEFAULT_SCALES, INTERACTIVE_SCALES
from ..sources.files import IMAGE_EXTENSIONS
from .derived import DUCK

PAGE = "doc_id, page_number"
ORDER = "source_rank, tile_y, seq"
BOX = "left_pt, bottom_pt, width_pt, height_pt"


def _q(pattern: str) -> str:
    return "'" + pattern.replace('\\"', '"').replace("'", "''") + "'"


def _strings(xs) -> str:
    return ", ".join(_q(x) for x in xs)


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {_q(f'^[{SPACE}]+|[{SPACE}]+$')}, '', 'g')"


def _uri(x: str) -> str:
    t = _trim(x)
    absolute = f"regexp_matches({t}, {_q(ABSOLUTE_URI)}) AND (NOT regexp_matches({t}, {_q(WEB_SCHEME)}) OR regexp_matches({t}, {_q(WEB_URI)}))"
    return f"CASE WHEN {absolute} THEN {t} WHEN starts_with(lower({t}), 'www.') THEN 'https://' || {t} END"


def _more(closer: str, opener: str) -> str:
    n = lambda c: f"(length(s) - length(replace(s, '{c}', '')))"
    return f"(right(s, 1) = '{closer}' AND {n(closer)} > {n(opener)})"


def _trimmed_end(x: str) -> str:
    strip = " OR ".join(["right(s, 1) IN (" + _strings(".,;:!?\"'") + ")", _more(")", "("), _more("]", "["), _more("}", "{")])
    run = f"length(regexp_extract({x}, {_q(chr(91) + '.,;:!?\"' + chr(39) + ')' + chr(92) + ']}' + ']*$')}))"
    return f"list_reduce(list_concat([{x}], list_transform(range({run}), lambda i: '')), lambda s, i: CASE WHEN {strip} THEN left(s, length(s) - 1) ELSE s END)"


def _matched(lines: str, pattern: str, where: str = "true") -> str:
    size = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda g: length(g))), 0)"
    return f"""SELECT {PAGE}, line_no, CAST(i - 1 AS INT) AS match_no, CAST({size('gaps[1:i]')} + {size('found[1:i-1]')} AS INT) AS start_off, found[i] AS value
FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT *, regexp_extract_all(line_text, {_q(pattern)}) AS found, string_split_regex(line_text, {_q(pattern)}) AS gaps FROM {lines}) m) n
WHERE {where}"""


def _area(a: str, b: str) -> str:
    """Whether boxes (fields x0, y0, x1, y1) share over half of the smaller one."""
    w = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
    h = f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    s = f"least(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0), ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0))"
    return f"({s} > 0 AND {w} > 0 AND {h} > 0 AND {w} * {h} > 0.5 * {s})"


def _text_spot(a: str, b: str) -> str:
    w = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
    return f"({w} > 0.5 * least({a}.x1 - {a}.x0, {b}.x1 - {b}.x0) AND abs(({a}.y0 + {a}.y1) / 2 - ({b}.y0 + {b}.y1) / 2) < greatest({a}.y1 - {a}.y0, {b}.y1 - {b}.y0))"


CORNERS = "'x0': left_pt, 'y0': bottom_pt, 'x1': left_pt + width_pt, 'y1': bottom_pt + height_pt"


def _kept(rows: str, keys: str, order: str, fields: str, near) -> str:
    """The greedy fold over rows: fields is the struct's text and holds x0, y0, x1, y1."""
    return f"""SELECT {keys}, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda kept, e: CASE WHEN len(list_filter(kept, lambda k: {near('k', 'e[1]')})) > 0 THEN kept ELSE list_concat(kept, e) END)) AS x
FROM (SELECT {keys}, list({{{fields}}} ORDER BY {order}) AS xs FROM {rows} GROUP BY {keys}) g"""


def _text(chunks: str, s: str = "") -> dict[str, str]:
    """Expressions from chunks to kept text spots; s ends their names."""
    page = f"PARTITION BY {PAGE} ORDER BY {ORDER}"
    line = f"PARTITION BY {PAGE}, line_no ORDER BY {ORDER}"
    box = "left_pt, bottom_pt, left_pt + width_pt AS right_pt, bottom_pt + height_pt AS top_pt"
    tld = "lower(regexp_extract(split_part(found[i], '/', 1), '\\.([A-Za-z]{2,24})$', 1))"
    cand = lambda bare, src: f"SELECT {PAGE}, line_no, {bare} AS is_bare, match_no, start_off, {_trimmed_end('value')} AS candidate FROM {src}{s}"
    target = "CASE WHEN is_bare = 1 THEN 'https://' || candidate ELSE candidate END"
    return {
        f"kept_chunks{s}": f"SELECT * FROM {chunks} WHERE regexp_matches(coalesce(text, ''), {_q(f'[^{SPACE}]')})",
        f"lined{s}": f"""SELECT *, CAST(sum(brk) OVER ({page}) AS INT) AS line_no FROM (
  SELECT *, CASE WHEN abs(bottom_pt - lag(bottom_pt) OVER ({page})) >= 0.5 * greatest(height_pt, lag(height_pt) OVER ({page})) THEN 1 ELSE 0 END AS brk FROM kept_chunks{s}) b""",
        f"spans{s}": f"""SELECT *, end_off - length(text) AS start_off, {box} FROM (SELECT *, CAST(sum(length(piece)) OVER ({line}) AS INT) AS end_off FROM (
  SELECT *, CASE WHEN left_pt - lag(left_pt + width_pt) OVER ({line}) > lag(space_width) OVER ({line}) / 2 THEN ' ' ELSE '' END || text AS piece FROM lined{s}) p) e""".replace(box, "left_pt + width_pt AS right_pt, bottom_pt + height_pt AS top_pt"),
        f"lines{s}": f"SELECT {PAGE}, line_no, string_agg(piece, '' ORDER BY {ORDER}) AS line_text, CAST(sum(start_off) AS BIGINT) AS sum_starts, CAST(count(*) AS INT) AS n_chunks FROM spans{s} GROUP BY {PAGE}, line_no",
        f"scheme{s}": _matched(f"lines{s}", SCHEME_URL),
        f"bare{s}": _matched(f"lines{s}", BARE_URL, f"{tld} IN ({_strings(TLDS)})"),
        f"bare_kept{s}": f"""SELECT * FROM bare{s} b WHERE NOT EXISTS (SELECT 1 FROM scheme{s} c WHERE c.doc_id = b.doc_id AND c.page_number = b.page_number AND c.line_no = b.line_no
  AND b.start_off < c.start_off + length(c.value) AND b.start_off + length(b.value) > c.start_off)""",
        f"cands_bare{s}": f"SELECT *, {_uri(target)} AS uri FROM ({cand(0, 'scheme')} UNION ALL {cand(1, 'bare_kept')}) c WHERE candidate <> '' AND ({_uri(target)}) IS NOT NULL",
        f"cands{s}": f"SELECT * FROM cands_bare{s} WHERE is_bare = 0",
        f"rects_bare{s}": _rects(f"cands_bare{s}", s),
        f"rects{s}": _rects(f"cands{s}", s),
        f"spots{s}": f"SELECT {PAGE}, x.* FROM ({_kept(f'rects{s}', PAGE, 'line_no, is_bare, match_no', f'''{CORNERS}, 'line_no': line_no, 'is_bare': is_bare, 'match_no': match_no, 'uri': uri, 'left_pt': left_pt, 'bottom_pt': bottom_pt, 'width_pt': width_pt, 'height_pt': height_pt''', _text_spot)}) y",
        f"text_links{s}": f"SELECT {PAGE}, 'text' AS source, 1 AS source_rank, CAST(line_no AS BIGINT) * 1000000 + is_bare * 500000 + match_no AS order_key, uri, {BOX}, {_status(f'spots{s}')} AS status FROM spots{s} c",
    }


def _rects(cands: str, s: str) -> str:
    return f"""SELECT c.doc_id, c.page_number, c.line_no, c.is_bare, c.match_no, c.uri, min(left_pt) AS left_pt, min(bottom_pt) AS bottom_pt, max(right_pt) - min(left_pt) AS width_pt, max(top_pt) - min(bottom_pt) AS height_pt
FROM {cands} c JOIN spans{s} p ON p.doc_id = c.doc_id AND p.page_number = c.page_number AND p.line_no = c.line_no AND p.start_off < c.start_off + length(c.candidate) AND p.end_off > c.start_off GROUP BY 1, 2, 3, 4, 5, 6"""


def _status(_: str, existing: str = "existing") -> str:
    here = "{'x0': c.left_pt, 'y0': c.bottom_pt, 'x1': c.left_pt + c.width_pt, 'y1': c.bottom_pt + c.height_pt}"
    there = "{'x0': e.left_pt, 'y0': e.bottom_pt, 'x1': e.left_pt + e.width_pt, 'y1': e.bottom_pt + e.height_pt}"
    near = _area("A_", "B_").replace("A_", f"({here})").replace("B_", f"({there})")
    return f"CASE WHEN EXISTS (SELECT 1 FROM {existing} e WHERE e.doc_id = c.doc_id AND e.page_number = c.page_number AND {near}) THEN 'already_linked' ELSE 'linked' END"


def _points(rows: str, keep: str) -> str:
    x, y = (lambda c: f"{c} * page_width_pt / bitmap_width"), (lambda c: f"(page_height_pt - {c} * page_height_pt / bitmap_height)")
    return f"SELECT {keep}, {x('px_left')} AS left_pt, {y('px_bottom')} AS bottom_pt, {x('px_right')} - {x('px_left')} AS width_pt, {y('px_top')} - {y('px_bottom')} AS height_pt FROM {rows} r JOIN pages_dim p ON p.doc_id = r.doc_id AND p.page_number = r.page_number"


def _int(x: str) -> str:
    return f"CAST(trunc({x}) AS INT)"


def _codes(hits: str) -> str:
    fields = "'x0': px_left, 'y0': px_top, 'x1': px_right, 'y1': px_bottom, 'level_no': level_no, 'inverted': inverted, 'decode_no': decode_no, 'px_left': px_left, 'px_top': px_top, 'px_right': px_right, 'px_bottom': px_bottom"
    keep = "x.level_no, x.inverted, x.decode_no, x.px_left, x.px_top, x.px_right, x.px_bottom"
    return f"SELECT {PAGE}, payload, {keep} FROM ({_kept(hits, f'{PAGE}, payload', 'level_no, inverted, decode_no', fields, _area)}) y"


def _words(table: str) -> str:
    """Words that aren't blank, at their place on the page."""
    return f"SELECT {PAGE}, CASE pass WHEN 'tile' THEN 2 ELSE 1 END AS source_rank, CASE pass WHEN 'tile' THEN tile_y ELSE 0 END AS tile_y, seq, {_trim('text')} AS text, px_left, px_right, px_top + CASE pass WHEN 'tile' THEN tile_y ELSE 0 END AS px_top, px_bottom + CASE pass WHEN 'tile' THEN tile_y ELSE 0 END AS px_bottom FROM {table} WHERE regexp_matches(coalesce(text, ''), {_q(f'[^{SPACE}]')})"


def _word_chunks(words: str) -> str:
    return f"SELECT *, CAST(0.3 AS DOUBLE) * height_pt AS space_width FROM ({_points(words, 'r.doc_id, r.page_number, source_rank, tile_y, seq, text')}) w"


_pad = "greatest(0.2 * greatest(x1 - x0, y1 - y0), 4.0)"
_side = lambda n, sign: _int(f"({n} {sign} {_pad}) * (bitmap_width / greatest(1, {_int('bitmap_width * scale')}))")
_corner = lambda f, c: f"list_{f}(list_transform(points, lambda q: q.{c}))"

PARTS: dict[str, str] = DUCK | {
    "existing": f"SELECT {PAGE}, {BOX} FROM annotations WHERE subtype = 'Link'",
    "boxes": f"""SELECT h.doc_id, h.page_number, level_no, inverted, decode_no, payload, scale, {_side('x0', '-')} AS px_left, {_side('y0', '-')} AS px_top, {_side('x1', '+')} AS px_right, {_side('y1', '+')} AS px_bottom
FROM (SELECT *, {_corner('min', 'x')} AS x0, {_corner('max', 'x')} AS x1, {_corner('min', 'y')} AS y0, {_corner('max', 'y')} AS y1 FROM qr_detections WHERE len(points) > 0) h JOIN pages_dim p ON p.doc_id = h.doc_id AND p.page_number = h.page_number""",
    "codes": _codes("boxes"),
    "boxes_a": f"SELECT * FROM boxes WHERE scale IN ({', '.join(map(str, DEFAULT_SCALES))})",
    "boxes_b": f"SELECT * FROM boxes WHERE scale IN ({', '.join(map(str, INTERACTIVE_SCALES))})",
    "codes_a": _codes("boxes_a"),
    "codes_b": _codes("boxes_b"),
    "code_points": _points("codes", "r.doc_id, r.page_number, level_no, inverted, decode_no, payload"),
    "qr_links": f"""SELECT {PAGE}, 'qr' AS source, 0 AS source_rank, CAST(level_no AS BIGINT) * 1000000 + CAST(inverted AS INT) * 500000 + decode_no AS order_key, uri, {BOX}, {_status('')} AS status
FROM (SELECT *, {_uri('payload')} AS uri FROM code_points) c WHERE uri IS NOT NULL""",
    "words": _words("ocr_words"),
    "word_chunks": _word_chunks("words"),
    "whole_chunks": "SELECT * FROM word_chunks WHERE source_rank = 1",
    "escalated": "SELECT doc_id, page_number FROM pages_dim p WHERE NOT EXISTS (SELECT 1 FROM rects_whole r WHERE r.doc_id = p.doc_id AND r.page_number = p.page_number)",
    "all_chunks": "SELECT * FROM text_chunks UNION ALL SELECT * FROM word_chunks w WHERE source_rank = 1 OR EXISTS (SELECT 1 FROM escalated e WHERE e.doc_id = w.doc_id AND e.page_number = w.page_number)",
    "found": "SELECT * FROM qr_links UNION ALL SELECT * FROM text_links_all",
    "tiles": f"SELECT {PAGE}, CAST(tile_y AS INT) AS tile_y, least(strip, bitmap_height - CAST(tile_y AS INT)) AS tile_height FROM (SELECT *, unnest(range(0, bitmap_height, greatest(1, {_int('strip * 0.5')}))) AS tile_y FROM (SELECT *, CAST(floor(bitmap_height / 6) AS INT) AS strip FROM pages_dim) q) s",
    "engine_words": f"""SELECT {PAGE}, pass, 0 AS tile_y, seq, text, px_left, px_top, px_right, px_bottom FROM ocr_words WHERE pass = 'whole'
UNION ALL SELECT t.doc_id, t.page_number, 'tile', t.tile_y, w.seq, w.text, px_left, px_top + w.tile_y - t.tile_y, px_right, px_bottom + w.tile_y - t.tile_y
FROM tiles t JOIN escalated e ON e.doc_id = t.doc_id AND e.page_number = t.page_number
JOIN ocr_words w ON w.doc_id = t.doc_id AND w.page_number = t.page_number AND px_top + w.tile_y >= t.tile_y AND px_bottom + w.tile_y <= t.tile_y + t.tile_height""",
    "engine_read": _words("engine_words"),
    "engine_chunks": _word_chunks("engine_read"),
    "chunks_with_engine": "SELECT * FROM text_chunks UNION ALL SELECT * FROM engine_chunks",
    "edited_chunks": "SELECT * REPLACE (CASE WHEN page_number = 99 AND doc_id % 10 = 0 THEN replace(text, 'wiki', 'en/page') ELSE text END AS text) FROM text_chunks",
    "found_with_engine": "SELECT * FROM qr_links UNION ALL SELECT * FROM text_links_engine",
    "existing_after": f"SELECT * FROM existing UNION ALL SELECT {PAGE}, {BOX} FROM found WHERE status = 'linked'",
}
PARTS |= _text("text_chunks") | _text("whole_chunks", "_whole") | _text("all_chunks", "_all") | _text("chunks_with_engine", "_engine") | _text("edited_chunks", "_edited")

_r = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
_RBOX = _r("left_pt", "bottom_pt", "width_pt", "height_pt")
_LINKS = f"{PAGE}, source, source_rank, order_key, uri, {_RBOX}, status"
_EXT = "CASE WHEN lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN (" + _strings(IMAGE_EXTENSIONS) + ") THEN 'image' ELSE 'document' END"
_FOUND_KEYS = f"{PAGE}, source, order_key"

SELECTS: dict[str, str] = {
    "s1_classify_inputs": f"SELECT doc_id, path, {_EXT} AS kind FROM paths",
    "s2_output_paths": "SELECT doc_id, path, regexp_extract(path, '^(.*/)?([^/]*)$', 1) || regexp_replace(regexp_extract(path, '^(.*/)?([^/]*)$', 2), '\\.[^.]*$', '') || '-linked.pdf' AS output FROM paths",
    "s3_link_annotations": f"SELECT {PAGE}, uri, {_RBOX}, 'Link' AS subtype, '0 0 0' AS border FROM found WHERE status = 'linked'",
    "s4_existing_links": "SELECT * FROM existing",
    "p1_drop_blank_chunks": f"SELECT {PAGE}, seq, text FROM kept_chunks",
    "p2_default_uri_filter": f"SELECT * FROM (SELECT *, {_uri('text')} AS uri FROM (SELECT {PAGE}, seq, text FROM text_chunks UNION ALL SELECT {PAGE}, -1 - level_no, payload FROM qr_detections) a) b WHERE uri IS NOT NULL",
    "p3_custom_uri_filter": f"SELECT {PAGE}, 'text' AS source, line_no, is_bare, match_no, uri || '?utm_source=qr' AS uri FROM cands_bare UNION ALL SELECT {PAGE}, 'qr', level_no, CAST(inverted AS INT), decode_no, uri || '?utm_source=qr' FROM (SELECT *, {_uri('payload')} AS uri FROM codes) c WHERE uri IS NOT NULL",
    "p4_pixel_box_to_points": f"SELECT {PAGE}, seq, {_RBOX} FROM ({_points('ocr_words', 'r.doc_id, r.page_number, seq')}) z",
    "p5_qr_padded_box": f"SELECT {PAGE}, level_no, inverted, decode_no, payload, px_left, px_top, px_right, px_bottom FROM boxes",
    "p6_pyramid_plan": f"""SELECT {PAGE}, level_no, scale, level_w, level_h, round(bitmap_width / level_w, 6) AS inverse_scale, inverted FROM (
  SELECT *, greatest(1, {_int('bitmap_width * scale')}) AS level_w, greatest(1, {_int('bitmap_height * scale')}) AS level_h FROM pages_dim
  CROSS JOIN (SELECT k AS level_no, CAST(s AS DOUBLE) AS scale FROM (VALUES {', '.join(f'({k}, {s})' for k, s in enumerate(DEFAULT_SCALES))}) v(k, s)) l) q CROSS JOIN (VALUES (false), (true)) i(inverted)""",
    "p7_ocr_tile_plan": "SELECT * FROM tiles",
    "p8_ocr_words_to_chunks": f"SELECT {PAGE}, source_rank, tile_y, seq, text, {_RBOX}, {_r('space_width')} FROM word_chunks",
    "p9_image_page_size": f"SELECT doc_id, round(bitmap_width * 72 / 150, 6) AS page_width_pt, round(bitmap_height * 72 / 150, 6) AS page_height_pt FROM paths WHERE {_EXT} = 'image'",
    "p10_link_edges": f"SELECT f.doc_id, f.page_number, source, order_key, round(left_pt + width_pt, 6) AS right_pt, round(bottom_pt + height_pt, 6) AS top_pt, left_pt >= 0 AND bottom_pt >= 0 AND left_pt + width_pt <= page_width_pt AND bottom_pt + height_pt <= page_height_pt AS inside FROM found f JOIN pages_dim p ON p.doc_id = f.doc_id AND p.page_number = f.page_number",
    "p11_overlay_percent": "SELECT f.doc_id, f.page_number, source, order_key, round(100 * left_pt / page_width_pt, 6) AS left_pc, round(100 * (page_height_pt - bottom_pt - height_pt) / page_height_pt, 6) AS top_pc, round(100 * width_pt / page_width_pt, 6) AS width_pc, round(100 * height_pt / page_height_pt, 6) AS height_pc FROM found f JOIN pages_dim p ON p.doc_id = f.doc_id AND p.page_number = f.page_number",
    "t1_group_lines": f"SELECT {PAGE}, seq, line_no FROM lined",
    "t2_reconstruct_lines": "SELECT * FROM lines",
    "t3_scheme_url_matches": "SELECT * FROM scheme",
    "t4_bare_domain_matches": "SELECT * FROM bare",
    "t5_drop_bare_under_scheme": "SELECT * FROM bare_kept",
    "t6_trim_trailing_punctuation": f"SELECT {PAGE}, seq, {_trimmed_end('text')} AS trimmed FROM text_chunks",
    "t7_candidate_uris": f"SELECT {PAGE}, line_no, is_bare, match_no, candidate, uri FROM cands_bare",
    "t8_match_to_rect": "SELECT * FROM rects_bare",
    "j1_split_existing": f"SELECT {PAGE}, line_no, match_no, uri, {_status('')} AS status FROM rects c",
    "j2_ocr_escalation_pages": "SELECT * FROM escalated",
    "j3_attach_page_size": "SELECT w.doc_id, w.page_number, seq, text, page_width_pt, page_height_pt, bitmap_width, bitmap_height FROM ocr_words w JOIN pages_dim p ON p.doc_id = w.doc_id AND p.page_number = w.page_number",
    "j4_compare_presets": "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_b, 0) >= coalesce(n_a, 0) AS no_worse FROM (SELECT doc_id, count(*) AS n_a FROM codes_a GROUP BY doc_id) a FULL JOIN (SELECT doc_id, count(*) AS n_b FROM codes_b GROUP BY doc_id) b ON a.doc_id = b.doc_id",
    "d1_dedupe_qr": "SELECT * FROM codes",
    "d2_dedupe_text_spots": f"SELECT {PAGE}, line_no, is_bare, match_no, uri, {BOX} FROM spots",
    "a1_document_summary": """SELECT doc_id, n_linked, n_already, CASE WHEN n_linked = 0 AND n_already = 0 THEN 'nothing found' ELSE CAST(n_linked AS VARCHAR) || CASE WHEN n_linked = 1 THEN ' link added' ELSE ' links added' END END AS message
FROM (SELECT d.doc_id, count(*) FILTER (WHERE status = 'linked') AS n_linked, count(*) FILTER (WHERE status = 'already_linked') AS n_already FROM (SELECT DISTINCT page_id AS doc_id FROM pages) d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id) n""",
    "a1_link_messages": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE status WHEN 'linked' THEN 0 ELSE 1 END, source_rank, page_number, order_key) AS INT) AS message_no, page_number, 'Page ' || page_number || CASE status WHEN 'linked' THEN ': " + LINKING + "' || uri ELSE ': ' || uri || '" + LEFT_ALONE + "' END AS message FROM found",
    "a2_pages_with_findings": f"SELECT DISTINCT {PAGE} FROM found",
    "a3_page_trace_counts": f"SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page_number, b.page_number) AS page_number, coalesce(n_codes, 0) AS n_codes, coalesce(n_text, 0) AS n_text FROM (SELECT {PAGE}, count(*) AS n_codes FROM codes GROUP BY {PAGE}) a FULL JOIN (SELECT {PAGE}, count(*) AS n_text FROM found WHERE source = 'text' AND status = 'linked' GROUP BY {PAGE}) b ON a.doc_id = b.doc_id AND a.page_number = b.page_number",
    "a4_debug_candidates": f"SELECT *, ({_uri('payload')}) IS NOT NULL AS accepted FROM codes",
    "w1_letter_findings": f"SELECT {_FOUND_KEYS}, status, chr(CAST(64 + row_number() OVER (PARTITION BY doc_id ORDER BY page_number, bottom_pt DESC, CASE status WHEN 'linked' THEN 0 ELSE 1 END, source_rank, order_key) AS INT)) AS letter FROM found",
    "o1_ordered_results": f"SELECT {PAGE}, source, uri, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY source_rank, page_number, order_key) AS INT) AS result_no FROM found",
    "u1_merge_sources": f"SELECT {_LINKS} FROM (SELECT * FROM qr_links UNION ALL SELECT * FROM text_links) l",
    "u2_merge_chunks": f"SELECT {PAGE}, source_rank, tile_y, seq, text, {_RBOX}, {_r('space_width')} FROM all_chunks",
    "u3_merge_status": f"SELECT {_FOUND_KEYS}, uri, status FROM found",
    "x1_scan_text": "SELECT * FROM text_links",
    "x2_scan_qr": f"SELECT {_LINKS} FROM qr_links",
    "x3_scan": f"SELECT {_LINKS} FROM found",
    "x3_scan_with_engine": f"SELECT {_LINKS} FROM found_with_engine",
    "x4_link": f"SELECT {PAGE}, uri, {_RBOX}, 'Link' AS subtype FROM found WHERE status = 'linked'",
    "x5_relink": f"SELECT {_FOUND_KEYS}, uri, {_status('', 'existing_after')} AS status FROM found c",
    "x5_incremental_relink": "SELECT * FROM text_links_edited",
    "e1_apply_ocr_engine": "SELECT t.doc_id, t.page_number, 'tile' AS pass, t.tile_y, w.seq, w.text, w.px_left, w.px_top - t.tile_y AS px_top, w.px_right, w.px_bottom - t.tile_y AS px_bottom FROM tiles t JOIN ocr_words w ON w.doc_id = t.doc_id AND w.page_number = t.page_number AND w.pass = 'whole' AND w.px_top >= t.tile_y AND w.px_bottom <= t.tile_y + t.tile_height",
}


def _needs(sql: str) -> list[str]:
    return [n for n in PARTS if re.search(rf"\b(?:FROM|JOIN) {n}\b", sql)]


def with_parts(select: str) -> str:
    """select after the expressions that it needs, each after those that it needs itself."""
    done: list[str] = []

    def add(sql: str) -> None:
        for n in _needs(sql):
            if n not in done:
                add(PARTS[n])
                done.append(n)

    add(select)
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in done) + "\n" + select


def oracle_sql() -> dict[str, str]:
    return {k: with_parts(v) for k, v in SELECTS.items()}
