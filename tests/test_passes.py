"""Passes located at once against the definition: probe the whole-page pass first, then merge what is left."""

import random

from linkfield.operators.lines import lines_by_pass, lines_of
from linkfield.options import ScanOptions
from linkfield.plans import jobs

from test_jobs import ANNOTATIONS, CHUNKS, HITS, PAGES, WORDS, chunk

PIECES = ("https://a.com/", "www.b.org/x", "see", "c.de/y", "path-2", "https:", "//d.net/z", "noise", ")", "/p?q=1", " ")


def made_page(draw, doc):
    """Chunks and words on few heights, so that lines run from real text into the pass and from there into tiles."""
    bottoms = (700.0, 689.0)
    chunks = [(doc, 1, 0, 0, k, draw.choice(PIECES), 72.0 + 40 * k, draw.choice(bottoms), 40.0, 9.6, 2.88) for k in range(draw.randint(0, 3))]
    word = lambda kind, k: (doc, 1, kind, 0, k, draw.choice(PIECES), 300 + 170 * (k + 4 * (kind == "tile")), top := int((792 - draw.choice(bottoms) - 9.6) * 3300 / 792), 300 + 170 * (k + 1 + 4 * (kind == "tile")), top + 40)
    return chunks, [word(kind, k) for kind in ("whole", "tile") for k in range(draw.randint(0, 3))]


def test_equal_to_two_passes(spark):
    draw = random.Random(8)
    made = [made_page(draw, d) for d in range(400)]
    chunks = spark.createDataFrame([c for page, _ in made for c in page], CHUNKS)
    words = spark.createDataFrame([w for _, page in made for w in page], WORDS)
    pages = spark.createDataFrame([(d, 1, 612.0, 792.0, 2550, 3300) for d in range(400)], PAGES)
    for options in (ScanOptions(), ScanOptions(match_bare_domains=True)):
        want = jobs.located_text(jobs.merge_chunks(chunks, jobs.ocr_chunks(words, pages, options)), options)
        got = jobs.located(chunks, words, spark.createDataFrame([], HITS), pages, options)
        rows = sorted(map(tuple, got.collect()))
        assert len(rows) > 100 and rows == sorted(map(tuple, want.collect()))
    parts = lines_by_pass(lines_of(jobs.merge_chunks(chunks, jobs.ocr_words_to_chunks(words, pages))))
    assert parts.where("not with_tiles").count() > 50 and parts.where("alone and not without_tiles").count() > 50


def test_space_before_a_part_goes(spark):
    chunks = [chunk("real", width=20), chunk("www.a.com", left=150, seq=1, rank=1), chunk("/b", left=350, seq=2, rank=2)]
    got = {r.line_text: r for r in lines_by_pass(lines_of(spark.createDataFrame(chunks, CHUNKS))).collect()}
    assert set(got) == {"www.a.com", "real www.a.com", "real www.a.com/b"}
    assert [(s.start_off, s.end_off) for s in got["www.a.com"].spans] == [(0, 9)] and got["www.a.com"].alone
    assert [(s.start_off, s.end_off) for s in got["real www.a.com"].spans] == [(0, 4), (5, 14)]


def test_no_rows(spark):
    none = [spark.createDataFrame([], s) for s in (CHUNKS, WORDS, HITS, PAGES, ANNOTATIONS)]
    assert jobs.scan(*none).count() == 0
