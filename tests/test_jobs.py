"""Jobs over literal rows: one small page per rule."""

import pytest
from pyspark.sql import functions as F

from linkfield.operators.dedupe import dedupe_qr, dedupe_text_spots
from linkfield.operators.detection import apply_ocr_engine, ocr_tile_plan, ocr_words_to_chunks, pyramid_plan, qr_padded_box, to_points
from linkfield.operators.existing import existing_links, split_existing
from linkfield.operators.lines import lines_of
from linkfield.operators.report import document_summary, letter_findings, link_messages
from linkfield.options import ScanOptions
from linkfield.plans import jobs
from linkfield.sources.files import classify_inputs, image_page_size, output_paths

CHUNKS = "doc_id long, page_number int, source_rank int, tile_y int, seq int, text string, left_pt double, bottom_pt double, width_pt double, height_pt double, space_width double"
ANNOTATIONS = "doc_id long, page_number int, subtype string, uri string, left_pt double, bottom_pt double, width_pt double, height_pt double"
PAGES = "doc_id long, page_number int, page_width_pt double, page_height_pt double, bitmap_width int, bitmap_height int"
WORDS = "doc_id long, page_number int, pass string, tile_y int, seq int, text string, px_left int, px_top int, px_right int, px_bottom int"
HITS = "doc_id long, page_number int, level_no int, scale double, inverted boolean, decode_no int, payload string, points array<struct<x:double,y:double>>"


def chunk(text, left=72, bottom=700, width=200, seq=0, rank=0, doc=1):
    return (doc, 1, rank, 0, seq, text, float(left), float(bottom), float(width), 12.0, 3.0)


def texts(spark, *chunks, annotations=(), **options):
    found = jobs.scan_text(spark.createDataFrame(list(chunks), CHUNKS), spark.createDataFrame(list(annotations), ANNOTATIONS), ScanOptions(**options))
    return sorted((r.uri, r.status, r.left_pt, r.width_pt) for r in found.collect())


def uris(*args, **options):
    return [r[0] for r in texts(*args, **options)]


def test_url_over_two_chunks(spark):
    got = texts(spark, chunk("See https://example.com/", width=100), chunk("split-here for details.", left=172, seq=1))
    assert got == [("https://example.com/split-here", "linked", 72.0, 300.0)]


def test_gap_adds_a_space(spark):
    assert uris(spark, chunk("https://a.com/x", width=100), chunk("y", left=180, seq=1)) == ["https://a.com/x"]


def test_order_is_trusted_and_lines_break(spark):
    chunks = [chunk("https://a.com/", bottom=700), chunk("b", bottom=600, seq=1), chunk("c", left=272, bottom=700, seq=2)]
    lines = lines_of(spark.createDataFrame(chunks, CHUNKS)).orderBy("line_no").collect()
    assert [r.line_text for r in lines] == ["https://a.com/", "b", "c"]


def test_bare_domains(spark):
    text = chunk("Visit https://qrco.de/trails-end or qrco.de/other.")
    assert uris(spark, text) == ["https://qrco.de/trails-end"]
    apart = [chunk("Get qrco.de/a.", bottom=700), chunk("https://qrco.de/b", bottom=600, seq=1)]
    assert uris(spark, *apart, match_bare_domains=True) == ["https://qrco.de/a", "https://qrco.de/b"]


def test_two_urls_in_one_chunk_keep_the_first(spark):
    assert uris(spark, chunk("https://a.com and https://b.com")) == ["https://a.com"]


def test_custom_filter(spark):
    only = lambda t: F.when(t.startswith("https://example.com/"), F.concat(t, F.lit("?utm_source=qr")))
    got = uris(spark, chunk("https://example.com/a"), chunk("https://other.org", bottom=600, seq=1), uri_filter=only)
    assert got == ["https://example.com/a?utm_source=qr"]


@pytest.mark.parametrize("shift, status", [(0, "already_linked"), (99, "already_linked"), (100, "linked"), (150, "linked")])
def test_over_half_of_the_smaller_box(spark, shift, status):
    link = (1, 1, "Link", None, 72.0 + shift, 700.0, 200.0, 12.0)
    note = (1, 1, "Text", None, 72.0, 700.0, 200.0, 12.0)
    got = texts(spark, chunk("https://a.com"), annotations=[link, note])
    assert [r[1] for r in got] == [status]


def test_zero_area_never_matches(spark):
    assert texts(spark, chunk("https://a.com"), annotations=[(1, 1, "Link", None, 72.0, 700.0, 0.0, 12.0)])[0][1] == "linked"


def test_real_text_beats_a_misread(spark):
    assert uris(spark, chunk("https://e.com/wif", rank=1, bottom=707), chunk("https://e.com/wlf")) == ["https://e.com/wlf"]


def test_dedup_runs_before_existing(spark):
    link = (1, 1, "Link", None, 72.0, 700.0, 200.0, 12.0)
    got = texts(spark, chunk("https://e.com/wlf"), chunk("https://e.com/wif", rank=1, bottom=706), annotations=[link])
    assert [r[:2] for r in got] == [("https://e.com/wlf", "already_linked")]


def test_chain_keeps_the_ends(spark):
    rows = [(1, 1, k, 0, 0, f"u{k}", 100.0 * k * 0.4, 0.0, 100.0, 12.0) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, line_no int, is_bare int, match_no int, uri string, left_pt double, bottom_pt double, width_pt double, height_pt double")
    assert sorted(r.uri for r in dedupe_text_spots(df).collect()) == ["u0", "u2"]


def test_large_pages_fold_in_numpy_alike(spark, monkeypatch):
    import random

    from linkfield.operators import dedupe

    draw = random.Random(3)
    rows = [(1, k % 2, k, 0, 0, f"u{k}", draw.uniform(0, 300), draw.uniform(0, 60), 80.0, 12.0) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, line_no int, is_bare int, match_no int, uri string, left_pt double, bottom_pt double, width_pt double, height_pt double")
    folded = sorted(r.uri for r in dedupe_text_spots(df).collect())
    monkeypatch.setattr(dedupe, "FOLD_ROWS", 10)
    assert sorted(r.uri for r in dedupe_text_spots(df.repartition(5)).collect()) == folded


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), HITS)


def square(x, y, side, scale=1.0):
    return [(x * scale, y * scale), ((x + side) * scale, y * scale), (x * scale, (y + side) * scale)]


def test_qr_levels_merge_and_places_stay(spark):
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0, 2550, 3300)], PAGES)
    rows = [(1, 1, lv, s, inv, 0, "https://a.com", square(600, 500, 400, s)) for lv, s in enumerate((1.0, 0.6, 0.4)) for inv in (False, True)]
    rows += [(1, 1, 0, 1.0, False, 1, "https://a.com", square(600, 1500, 400)), (1, 1, 0, 1.0, False, 2, "plain", square(600, 2500, 400)), (1, 1, 0, 1.0, False, 3, "x", [])]
    codes = dedupe_qr(qr_padded_box(hits(spark, *rows), pages))
    assert sorted((r.payload, r.px_left, r.px_top) for r in codes.collect()) == [("https://a.com", 520, 420), ("https://a.com", 520, 1420), ("plain", 520, 2420)]
    links = jobs.scan_qr(hits(spark, *rows), pages, spark.createDataFrame([], ANNOTATIONS)).orderBy("bottom_pt").collect()
    assert [r.uri for r in links] == ["https://a.com"] * 2 and links[0].bottom_pt < links[1].bottom_pt


def test_boxes_flip_and_scale(spark):
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0, 2550, 3300)], PAGES)
    row = spark.createDataFrame([(1, 1, "whole", 0, 0, " w ", 100, 100, 500, 140), (1, 1, "whole", 0, 1, "  ", 0, 0, 1, 1)], WORDS)
    got = ocr_words_to_chunks(row, pages).collect()
    assert len(got) == 1 and got[0].text == "w"
    assert (got[0].left_pt, got[0].width_pt) == pytest.approx((24.0, 96.0)) and (got[0].bottom_pt, got[0].height_pt) == pytest.approx((758.4, 9.6))
    assert got[0].space_width == pytest.approx(2.88)
    assert to_points(row.where("seq = 9"), pages).count() == 0


def test_plans(spark):
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0, 100, 120), (2, 1, 612.0, 792.0, 3, 5)], PAGES)
    tiles = [(r.tile_y, r.tile_height) for r in ocr_tile_plan(pages).where("doc_id = 1").orderBy("tile_y").collect()]
    assert tiles[0] == (0, 20) and tiles[1] == (10, 20) and tiles[-1] == (110, 10) and len(tiles) == 12
    assert ocr_tile_plan(pages).where("doc_id = 2").count() == 0
    levels = pyramid_plan(pages, (1.0, 0.25)).where("not inverted").orderBy("doc_id", "level_no").collect()
    assert [(r.level_w, r.level_h) for r in levels] == [(100, 120), (25, 30), (3, 5), (1, 1)]


def test_tiles_only_where_the_whole_pass_found_nothing(spark):
    pages = spark.createDataFrame([(d, 1, 612.0, 792.0, 2550, 3300) for d in (1, 2)], PAGES)
    words = [(1, 1, "whole", 0, 0, "https://whole.com", 100, 100, 500, 140), (2, 1, "whole", 0, 0, "noise", 100, 100, 500, 140)]
    words += [(d, 1, "tile", 550, 1, "https://tile.com", 100, 20, 900, 60) for d in (1, 2)]
    none = spark.createDataFrame([], CHUNKS), spark.createDataFrame([], HITS), spark.createDataFrame([], ANNOTATIONS)
    found = jobs.scan(none[0], spark.createDataFrame(words, WORDS), none[1], pages, none[2]).collect()
    assert sorted((r.doc_id, r.uri) for r in found) == [(1, "https://whole.com"), (2, "https://tile.com")]
    assert [round(r.bottom_pt, 2) for r in found if r.doc_id == 2] == [round(792 - 610 * 792 / 3300, 2)]


def test_relink_adds_nothing(spark):
    chunks = spark.createDataFrame([chunk("https://a.com"), chunk("https://b.com", bottom=500, seq=1), chunk("https://c.com", seq=0, doc=2)], CHUNKS)
    pages = spark.createDataFrame([(d, 1, 612.0, 792.0, 2550, 3300) for d in (1, 2)], PAGES)
    tables = chunks, None, spark.createDataFrame([(1, 1, 0, 1.0, False, 0, "https://q.com", square(600, 500, 400))], HITS), pages, spark.createDataFrame([], ANNOTATIONS)
    first, again = jobs.scan(*tables).collect(), jobs.relink(*tables).collect()
    assert len(first) == 4 and {r.status for r in first} == {"linked"}
    assert len(again) == 4 and {r.status for r in again} == {"already_linked"}
    assert len(jobs.link(*tables).collect()) == 4


def test_partitions_and_order_of_rows_do_not_matter(spark):
    rows = [chunk(f"https://a{k}.com", bottom=700 - 20 * k, seq=k, doc=d) for d in range(3) for k in range(5)]
    asc = spark.createDataFrame(rows, CHUNKS).coalesce(1)
    desc = spark.createDataFrame(rows[::-1], CHUNKS).repartition(7)
    none = spark.createDataFrame([], ANNOTATIONS)
    assert sorted(map(tuple, jobs.scan_text(asc, none).collect())) == sorted(map(tuple, jobs.scan_text(desc, none).collect()))


def test_reports(spark):
    links = [(1, 1, "qr", 0, k, f"u{k}", 0.0, float(100 - k), 10.0, 10.0, "linked" if k else "already_linked") for k in range(27)]
    df = spark.createDataFrame(links, "doc_id long, page_number int, source string, source_rank int, order_key long, uri string, left_pt double, bottom_pt double, width_pt double, height_pt double, status string")
    letters = [r.letter for r in letter_findings(df).orderBy("order_key").collect()]
    assert letters[0] == "A" and letters[25] == "Z" and letters[26] == "["
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert {r.doc_id: (r.n_linked, r.n_already, r.message) for r in document_summary(docs, df).collect()} == {1: (26, 1, "26 links added"), 2: (0, 0, "nothing found")}


def test_files(spark):
    paths = spark.createDataFrame([("/a.b/c.PNG", 600, 300), ("x", 1, 1), ("/d/e.tar.gz", 1, 1)], "path string, bitmap_width int, bitmap_height int")
    got = {r.path: (r.kind, r.output, r.page_width_pt) for r in image_page_size(output_paths(classify_inputs(paths))).collect()}
    assert got["/a.b/c.PNG"] == ("image", "/a.b/c-linked.pdf", 288.0) and got["x"][:2] == ("document", "x-linked.pdf") and got["/d/e.tar.gz"][1] == "/d/e.tar-linked.pdf"


def test_paths_and_the_link_table(spark, tmp_path):
    from linkfield.sources.files import read_contents, read_paths, write_links

    (tmp_path / "a.png").write_bytes(b"abc")
    assert [(r.length, r.path.endswith("a.png")) for r in read_paths(spark, str(tmp_path)).collect()] == [(3, True)]
    assert bytes(read_contents(spark, str(tmp_path)).first().content) == b"abc"
    links = jobs.scan_text(spark.createDataFrame([chunk("https://a.com")], CHUNKS), spark.createDataFrame([], ANNOTATIONS))
    write_links(links, str(tmp_path / "links"))
    assert [r.status for r in spark.read.parquet(str(tmp_path / "links")).collect()] == ["linked"]


def test_no_engine_no_words(spark):
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0, 100, 120)], PAGES)
    assert apply_ocr_engine(ocr_tile_plan(pages), None).count() == 0


def test_empty_tables(spark):
    none = [spark.createDataFrame([], s) for s in (CHUNKS, WORDS, HITS, PAGES, ANNOTATIONS)]
    assert jobs.scan(*none).count() == 0 and split_existing(jobs.text_candidates(none[0]), existing_links(none[4])).count() == 0


def test_landing_folder(spark, tmp_path):
    from linkfield.streaming.landing import link_landing_folder

    spark.createDataFrame([chunk("https://a.com")], CHUNKS).write.parquet(str(tmp_path / "in"))
    query = link_landing_folder(spark, str(tmp_path / "in"), CHUNKS, lambda: spark.createDataFrame([], ANNOTATIONS), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert [r.uri for r in spark.read.parquet(str(tmp_path / "out" / "batch=0")).collect()] == ["https://a.com"]


def test_letters_of_hundreds_of_findings(spark):
    df = spark.range(300).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_number"), F.lit(5.0).alias("bottom_pt"), F.lit("linked").alias("status"), F.lit(0).alias("source_rank"), F.col("id").alias("order_key"))
    got = [r.letter for r in letter_findings(df).orderBy("order_key").collect()]
    assert got == [chr(65 + k) for k in range(300)] and got[191] == "\u0100" and got[256] == "\u0141"


def test_messages(spark):
    rows = [(1, 2, "linked", 0, 5, "https://b"), (1, 1, "already_linked", 1, 1, "https://c"), (1, 1, "linked", 1, 9, "https://a"), (2, 7, "already_linked", 0, 1, "x:y")]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, status string, source_rank int, order_key long, uri string")
    got = [(r.doc_id, r.message_no, r.message) for r in link_messages(df).orderBy("doc_id", "message_no").collect()]
    assert got == [(1, 1, "Page 2: linking to https://b"), (1, 2, "Page 1: linking to https://a"), (1, 3, "Page 1: https://c is already linked, left alone"), (2, 1, "Page 7: x:y is already linked, left alone")]
    assert link_messages(df.where("false")).count() == 0


def test_an_engine_reads_tiles(spark):
    import pandas as pd

    from linkfield.operators.detection import apply_ocr_engine

    def engine(batches):
        for tiles in batches:
            yield pd.DataFrame({"doc_id": tiles["doc_id"], "page_number": tiles["page_number"], "pass": "tile", "tile_y": tiles["tile_y"], "seq": 0, "text": "https://e.org/" + tiles["tile_y"].astype(str), "px_left": 1, "px_top": 2, "px_right": 30, "px_bottom": 9})

    tiles = spark.createDataFrame([(1, 1, 0, 100), (1, 1, 50, 100)], "doc_id long, page_number int, tile_y int, tile_height int")
    assert sorted(r.text for r in apply_ocr_engine(tiles, engine).collect()) == ["https://e.org/0", "https://e.org/50"]
