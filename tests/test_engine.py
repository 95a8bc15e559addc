"""An OCR engine inside the scan."""

import os

import pandas as pd
import pytest

from linkfield.operators.detection import OcrEngine, rendered_sizes
from linkfield.options import INTERACTIVE, ScanOptions
from linkfield.plans import jobs
from test_jobs import ANNOTATIONS, CHUNKS, HITS, PAGES, chunk


def reader(log, known):
    """An engine that writes down when it is set up and what it is asked for; known: words by page and, of tiles, by top."""

    def open_engine():
        with open(f"{log}/opened", "a") as f:
            f.write(f"{os.getpid()}\n")

        def read(tasks):
            with open(f"{log}/asked", "a") as f:
                f.writelines(f"{r.doc_id} {getattr(r, '_fields') and tasks['pass'][i]} {r.tile_y} {r.tile_height}\n" for i, r in zip(tasks.index, tasks.itertuples()))
            rows = [(r.doc_id, r.page_number, kind, r.tile_y, k, w, 100, 20 + 60 * k, 500, 50 + 60 * k) for r, kind in zip(tasks.itertuples(), tasks["pass"]) for k, w in enumerate(known.get((r.doc_id, kind, r.tile_y), ()))]
            return pd.DataFrame(rows, columns=["doc_id", "page_number", "pass", "tile_y", "seq", "text", "px_left", "px_top", "px_right", "px_bottom"])

        return read

    return OcrEngine(str(log), open_engine)


def tables(spark, n):
    pages = spark.createDataFrame([(d, 1, 612.0, 792.0, 2550, 3300) for d in range(1, n + 1)] + [(99, 1, 612.0, 792.0, 0, 0)], PAGES)
    return spark.createDataFrame([], HITS), pages, spark.createDataFrame([], ANNOTATIONS)


def test_tiles_only_where_the_whole_pass_found_nothing(spark, tmp_path):
    known = {(1, "whole", 0): ["https://whole.com/a"], (1, "tile", 550): ["https://never.com"], (2, "whole", 0): ["noise", "www.", " "], (2, "tile", 550): ["https://tile.com/b"], (3, "whole", 0): ["qrco.de/bare"]}
    detections, pages, annotations = tables(spark, 3)
    chunks = spark.createDataFrame([chunk("https://text.com", doc=3)], CHUNKS)
    found = jobs.scan(chunks, None, detections, pages, annotations, ScanOptions(ocr_engine=reader(tmp_path, known))).collect()
    assert sorted((r.doc_id, r.uri) for r in found) == [(1, "https://whole.com/a"), (2, "https://tile.com/b"), (3, "https://text.com")]
    assert [round(r.bottom_pt, 2) for r in found if r.doc_id == 2] == [round(792 - 600 * 792 / 3300, 2)]
    asked = [line.split() for line in open(tmp_path / "asked")]
    assert sorted((d, int(y)) for d, kind, y, _ in asked if kind == "whole") == [("1", 0), ("2", 0), ("3", 0)]
    assert sorted((d, int(y)) for d, kind, y, _ in asked if kind == "tile") == [(d, y) for d in "23" for y in range(0, 3300, 275)]  # real text isn't in the probe
    opened = open(tmp_path / "opened").read().split()
    assert len(opened) == len(set(opened))
    again = jobs.scan(chunks, None, detections, pages, annotations, ScanOptions(ocr_engine=reader(tmp_path, known), match_bare_domains=True)).collect()
    assert {(r.doc_id, r.uri) for r in again if r.doc_id == 3} == {(3, "https://text.com"), (3, "https://qrco.de/bare")}
    new = [line.split() for line in open(tmp_path / "asked")][len(asked) :]
    assert {d for d, kind, *_ in new if kind == "tile"} == {"2"}  # a bare domain is a find, too


def test_what_the_engine_read_is_read_once(spark, tmp_path):
    detections, pages, annotations = tables(spark, 4)
    found = jobs.scan(spark.createDataFrame([], CHUNKS), None, detections, pages, annotations, ScanOptions(ocr_engine=reader(tmp_path, {(d, "whole", 0): [f"https://e.org/{d}"] for d in (1, 2, 3, 4)})))
    assert found.count() == 4 and found.where("status = 'linked'").count() == 4
    assert sorted(line.split()[0] for line in open(tmp_path / "asked")) == ["1", "2", "3", "4"]


def test_engine_and_words_exclude_each_other(spark):
    detections, pages, annotations = tables(spark, 1)
    with pytest.raises(ValueError):
        jobs.scan(spark.createDataFrame([], CHUNKS), pages, detections, pages, annotations, ScanOptions(ocr_engine=OcrEngine("e", lambda: None)))


def test_no_pages(spark, tmp_path):
    detections, pages, annotations = tables(spark, 2)
    none = jobs.scan(spark.createDataFrame([], CHUNKS), None, detections, pages.where("false"), annotations, ScanOptions(ocr_engine=reader(tmp_path, {})))
    assert none.count() == 0 and not (tmp_path / "opened").exists()


def test_options_decide_levels_and_sizes(spark):
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0, 0, 0)], PAGES)
    assert [(r.bitmap_width, r.bitmap_height) for r in rendered_sizes(pages, 400).collect()] == [(3400, 4400)]
    tasks = jobs.detector_tasks(pages, INTERACTIVE).where("not inverted").orderBy("level_no").collect()
    assert [(r.level_w, r.level_h) for r in tasks] == [(2550, 3300), (1275, 1650), (637, 825)]
    sized = spark.createDataFrame([(1, 1, 612.0, 792.0, 2550, 3300)], PAGES)
    hits = spark.createDataFrame([(1, 1, 1, 0.6, False, 0, "https://a.com", [(60.0, 60.0), (120.0, 60.0), (60.0, 120.0)])], HITS)
    none = spark.createDataFrame([], ANNOTATIONS)
    assert jobs.scan_qr(hits, sized, none).count() == 1 and jobs.scan_qr(hits, sized, none, INTERACTIVE).count() == 0
