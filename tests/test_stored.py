"""Tables with buckets by page, traces of a running scan, files as a source, table functions."""

import pytest
from pyspark.sql import functions as F

from linkfield.operators.existing import existing_links, split_existing
from linkfield.operators.report import page_trace_counts
from linkfield.operators.dedupe import dedupe_qr
from linkfield.operators.detection import qr_padded_box
from linkfield.plans import jobs
from linkfield.sources.files import write_by_page
from test_jobs import ANNOTATIONS, CHUNKS, HITS, PAGES, chunk, square


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    chunks = spark.createDataFrame([chunk(f"https://e.org/{d}", doc=d) for d in range(40)], CHUNKS)
    links = spark.createDataFrame([(d, 1, "Link", None, 72.0, 700.0, 200.0, 12.0) for d in range(0, 40, 2)], ANNOTATIONS)
    tables = {"t_chunks": chunks, "t_annotations": links, "t_located": jobs.located_text(chunks)}
    for name, df in tables.items():
        write_by_page(df, name, 8, "overwrite")
    yield {name: spark.table(name) for name in tables}
    for name in tables:
        spark.sql(f"DROP TABLE {name}")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_judging_stored_links_shuffles_nothing(spark, stored):
    judged = split_existing(stored["t_located"], existing_links(stored["t_annotations"]), stored_by_page=True)
    assert "Exchange" not in plan(judged) and "ExistenceJoin" in plan(judged)
    assert judged.where("status = 'already_linked'").count() == 20
    again = split_existing(stored["t_located"], existing_links(stored["t_annotations"].unionByName(stored["t_annotations"].where("false"))), stored_by_page=True)
    assert again.count() == 40


def test_lines_of_stored_chunks_shuffle_nothing(spark, stored):
    assert "Exchange" not in plan(jobs.text_candidates(stored["t_chunks"])) and jobs.text_candidates(stored["t_chunks"]).count() == 40


def test_a_trace_counts_along(spark):
    chunks = spark.createDataFrame([chunk("https://a.com"), chunk("https://b.com", bottom=500, seq=1), chunk("https://c.com", doc=2)], CHUNKS)
    pages = spark.createDataFrame([(d, 1, 612.0, 792.0, 2550, 3300) for d in (1, 2)], PAGES)
    rows = [(1, 1, lv, s, False, 0, t, square(600, y, 400, s)) for lv, s in enumerate((1.0, 0.6)) for t, y in (("https://q.com", 500), ("plain", 1500))]
    hits, annotations = spark.createDataFrame(rows, HITS), spark.createDataFrame([(2, 1, "Link", None, 72.0, 700.0, 200.0, 12.0)], ANNOTATIONS)
    trace = jobs.Trace()
    links = jobs.scan(chunks, None, hits, pages, annotations, trace=trace).collect()
    sums = page_trace_counts(dedupe_qr(qr_padded_box(hits, pages)), jobs.scan(chunks, None, hits, pages, annotations)).agg(F.sum("n_codes"), F.sum("n_text")).first()
    assert (trace.totals["n_codes"], trace.totals["n_text"]) == tuple(sums) == (2, 2)
    assert trace.totals == {"n_codes": 2, "n_no_uri": 1, "n_text": 2, "n_text_already": 1, "n_qr": 1, "n_qr_already": 0} and len(links) == 4


def test_files_are_dealt_by_bytes(spark, tmp_path):
    from linkfield.sources.listing import PageFiles, dealt

    sizes = [1000, 10, 10, 900, 500, 480, 20, 0]
    for k, n in enumerate(sizes):
        (tmp_path / f"d{k % 2}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 2}" / f"{k}.{'PNG' if k < 3 else 'pdf'}").write_bytes(b"x" * n)
    (tmp_path / "_tmp").mkdir()
    (tmp_path / "_tmp" / "hidden.pdf").write_bytes(b"no")
    loads = [sum(n for _, n in t.files) for t in dealt([(str(k), n) for k, n in enumerate(sizes)], 1000)]
    assert len(loads) == 3 and max(loads) == 1000 and min(loads) >= 900
    spark.dataSource.register(PageFiles)
    of = lambda **options: spark.read.format("page_files").options(path=str(tmp_path), **options).load()
    got = of(bytesPerTask=1000)
    assert got.rdd.getNumPartitions() == 3 and sorted(r.length for r in got.collect()) == sorted(sizes)
    assert {r.path.rsplit("/", 1)[1]: r.kind for r in got.collect()} == {f"{k}.{'PNG' if k < 3 else 'pdf'}": "image" if k < 3 else "document" for k in range(8)}
    assert sorted(len(r.content) for r in of(content="true").collect()) == sorted(sizes)
    (tmp_path / "none").mkdir()
    assert spark.read.format("page_files").load(str(tmp_path / "none")).count() == 0


def test_new_files_as_a_stream(spark, tmp_path):
    from linkfield.sources.listing import PageFiles

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"1")
    spark.dataSource.register(PageFiles)

    def run():
        stream = spark.readStream.format("page_files").option("path", str(tmp_path / "in")).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.schema("path string").parquet(str(tmp_path / "out")).collect())

    assert run() == ["a.pdf"]
    (tmp_path / "in" / "b.png").write_bytes(b"22")
    assert run() == ["a.pdf", "b.png"]


def test_matches_in_sql(spark):
    from linkfield.functions.tables import register
    from linkfield.operators.candidates import bare_domain_matches, scheme_url_matches

    texts = ["see https://a.com/x and WWW.b.org, qrco.de/y v1.2/beta a@q.io/z.", None, "", "no", "http://ü.de/\u00a0x https://\u2028y", "xwww.a.b/c 3.14/2 e.zz/1 f.com/2", "éa.com/p"]
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, line_text string")
    register(spark)
    lines.createOrReplaceTempView("some_lines")
    for bare, name, df in ((False, "scheme", scheme_url_matches(lines)), (True, "bare", bare_domain_matches(lines))):
        want = sorted((r.k, r.m.match_no, r.m.start_off, r.m.value) for r in df.select("k", F.explode(name).alias("m")).collect())
        got = spark.sql(f"SELECT k, match_no, start_off, value FROM url_matches(TABLE(some_lines), 'line_text', {str(bare).lower()})").collect()
        assert sorted(map(tuple, got)) == want and want
    assert spark.sql("SELECT * FROM url_matches(TABLE(SELECT * FROM some_lines WHERE k < 0) PARTITION BY (k), 'line_text', false)").count() == 0
