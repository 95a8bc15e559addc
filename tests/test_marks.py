"""Pages that can't have a URL are told before anything is lined."""

import random

from pyspark.sql import Observation, functions as F

from linkfield.operators import lines
from linkfield.operators.candidates import candidate_uris, drop_bare_under_scheme, match_to_rect, bare_domain_matches, scheme_url_matches
from linkfield.options import ScanOptions
from linkfield.plans import incremental, jobs
from linkfield.sources.shared import shared_dir

CHUNKS = "doc_id long, page_number int, source_rank int, tile_y int, seq int, text string, left_pt double, bottom_pt double, width_pt double, height_pt double, space_width double"


def _page(doc, texts, gaps=None, page=1):
    out, left = [], 0.0
    for i, text in enumerate(texts):
        left += (gaps[i] if gaps else 5.0)
        out.append((doc, page, 0, 0, i, text, left, 700.0, 10.0, 12.0, 4.0))
        left += 10.0
    return out


def test_marks_in_pieces(spark):
    """Marks cut anywhere, with white chunks and spaces between, give what lining all pages gives."""
    rnd, rows = random.Random(7), []
    for doc in range(300):
        url = rnd.choice(["https://example.org/a", "WWW.Example.org/b", "wWw.x.com", "example.com/deep", "http:// x", "ww.w.x", "plain words", "a:/b", "html: //x.de", "mailto:a@b.c"])
        cuts = sorted(rnd.sample(range(1, len(url)), rnd.randint(0, min(6, len(url) - 1))))
        pieces = [url[a:b] for a, b in zip([0, *cuts], [*cuts, len(url)])]
        for _ in range(rnd.randint(0, 2)):
            pieces.insert(rnd.randint(0, len(pieces)), rnd.choice([None, "  ", "\u00a0", "how", "now:", "word"]))
        rows += _page(doc, pieces, [rnd.choice([0.0, 0.0, 0.0, 5.0]) for _ in pieces])
    chunks = spark.createDataFrame(rows, CHUNKS)
    for bare in (False, True):
        options = ScanOptions(match_bare_domains=bare)
        all_lines = bare_domain_matches(scheme_url_matches(lines.lines_of(chunks)), bare)
        want = match_to_rect(candidate_uris(drop_bare_under_scheme(all_lines)))
        key = lambda df: sorted(map(tuple, df.collect()))
        assert key(jobs.text_candidates(chunks, options)) == key(want)
        assert len(key(want)) > 30


def _lined(monkeypatch, module, seen):
    plain = lines.lines_of
    monkeypatch.setattr(module, "lines_of", lambda chunks: plain(chunks.observe(seen, F.count(F.lit(1)).alias("n"))))


def test_other_pages_are_not_lined(spark, monkeypatch):
    rows = [r for doc in range(50) for r in _page(doc, ["word", "now", "other"] * 20)] + _page(99, ["see", "https://example.org/a"])
    seen = Observation("lined")
    _lined(monkeypatch, jobs, seen)
    assert [r.uri for r in jobs.text_candidates(spark.createDataFrame(rows, CHUNKS)).collect()] == ["https://example.org/a"]
    assert seen.get["n"] < 200  # of 3002


def test_pages_by_bits(spark):
    rows = spark.range(20000).selectExpr("id as doc_id", "cast(id % 3 as int) as page_number", "id as x")
    wanted = rows.where("doc_id % 40 = 0")
    got = {r.x for r in lines.of_pages(rows, wanted.select("doc_id", "page_number")).collect()}
    assert {r.x for r in wanted.collect()} <= got and len(got) < 520


def test_states_of_a_page_are_not_mixed(spark, monkeypatch):
    """Of two states in one run the later counts, and the earlier one's pieces don't come between its own."""
    path = f"{shared_dir(spark)}/marks-in"
    old, new = _page(1, ["x", "y", "z", "q"], [0.0] * 4), _page(1, ["ht", "tp:/", "/a.org/", "b"], [0.0] * 4)
    gone = _page(2, ["https://b.org/x"]), _page(2, ["no more"])
    for n, rows in enumerate((old + gone[0], new + gone[1])):
        spark.createDataFrame(rows, CHUNKS).write.parquet(f"{path}/batch={n}")
    seen = Observation("lined")
    _lined(monkeypatch, jobs, seen)
    got = incremental.scan_changes(spark, path, f"{path}-state", parts=2)
    assert [r.uri for r in got.collect()] == ["http://a.org/b"]
    assert seen.get["n"] == 4


def test_chunks_of_all_lines_are_dealt_to_many_tasks(spark):
    """Spark would join the partitions of a shuffle, and a task's memory would grow with the input."""
    chunks = spark.createDataFrame([r for doc in range(400) for r in _page(doc, ["a", "b"])], CHUNKS)
    used = lines.group_lines(lines.dealt_by_page(chunks)).select(F.spark_partition_id().alias("p"), "doc_id").distinct().groupBy("p").count().collect()
    assert len(used) > 24 and max(r["count"] for r in used) < 40 and sum(r["count"] for r in used) == 400


def test_lines_without_marks_are_not_put_together(spark, monkeypatch):
    """Of a page with a URL in pieces only the URL's line is put together, with the number that it has among all."""
    rows = [(1, 1, 0, 0, i, "word", 0.0, 700.0 - 20 * i, 10.0, 12.0, 4.0) for i in range(30)]
    rows += [(1, 1, 0, 0, 30 + i, text, 10.0 * i, 20.0, 10.0, 12.0, 4.0) for i, text in enumerate(("http:", "//example.org", "/a"))]
    chunks, seen, plain = spark.createDataFrame(rows, CHUNKS), Observation("put together"), lines.reconstruct_lines
    sifted = lines.pages_with_marks(chunks, False)
    monkeypatch.setattr(lines, "reconstruct_lines", lambda spans: plain(spans.observe(seen, F.count(F.lit(1)).alias("n"))))
    assert [(r.line_no, r.line_text) for r in lines.lines_of(sifted).collect()] == [(30, "http://example.org/a")]
    assert seen.get["n"] == 3  # of 33


def test_targets_are_worked_out_once(spark):
    """A filter on the target doesn't bring its patterns into the plan again for each place that refers to it."""
    chunks = spark.createDataFrame(_page(1, ["see", " https://example.org/a).", "www.example.org"]), CHUNKS)
    found = jobs.text_candidates(chunks)
    assert [r.uri for r in found.orderBy("match_no").collect()] == ["https://example.org/a", "https://www.example.org"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[A-Za-z][A-Za-z0-9+.-]*:") == 1
