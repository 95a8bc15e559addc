"""Chunks that come in pieces: shuffled streams, edited batches."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from linkfield.plans import incremental, jobs
from linkfield.streaming.pages import CHUNKS, link_pages_as_they_close
from test_jobs import ANNOTATIONS, chunk

AT = dt.datetime(2026, 1, 1)


def pages(n, words=6):
    return [chunk(f"https://e.org/{d}/{k}" if k % 2 else "and then", bottom=700 - 20 * (k // 2), left=72 + 200 * (k % 2), width=180, seq=k, doc=d) for d in range(n) for k in range(words)]


def links_of(rows):
    return sorted((r.doc_id, r.page_number, r.uri, r.left_pt, r.width_pt) for r in rows)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_shuffled_arrival_over_batches(spark, rocksdb, tmp_path):
    rows = pages(12)
    annotations = spark.createDataFrame([(1, 1, "Link", None, 272.0, 700.0, 180.0, 12.0)], ANNOTATIONS)
    draw = random.Random(3)
    timed = [(*r, AT + dt.timedelta(seconds=draw.randrange(120))) for r in rows]
    draw.shuffle(timed)
    late = (*chunk("https://late.org", doc=3, seq=99), AT + dt.timedelta(hours=3))
    batches = [timed[0::3], timed[1::3], timed[2::3], [(*chunk("tick", doc=100), AT + dt.timedelta(hours=2))], [(*chunk("tick", doc=100, seq=1), AT + dt.timedelta(hours=2))], [late, (*chunk("tock", doc=101), AT + dt.timedelta(hours=4))]]
    schema = CHUNKS + ", at timestamp"
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"tmp{k}"))
        (part,) = glob.glob(str(tmp_path / f"tmp{k}" / "*.parquet"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(part, tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = link_pages_as_they_close(stream, lambda: annotations, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(240)
    assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out" / "links")).where("doc_id < 100").collect()
    want = jobs.scan_text(spark.createDataFrame(rows, CHUNKS), annotations).where("status = 'linked'").collect()
    assert links_of(got) == links_of(want) and len(want) == 35
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out" / "late")).collect()] == ["https://late.org"]


def put(spark, path, number, rows):
    spark.createDataFrame(rows, CHUNKS).write.parquet(f"{path}/in/batch={number}")


def test_only_changes_are_scanned(spark, tmp_path, monkeypatch):
    path, state = str(tmp_path), str(tmp_path / "state")
    seen = []
    real = incremental.located_text
    monkeypatch.setattr(incremental, "located_text", lambda chunks, options: (seen.append(sorted(r.doc_id for r in chunks.select("doc_id").distinct().collect())), real(chunks, options))[1])
    run = lambda: incremental.scan_changes(spark, f"{path}/in", state, parts=4)
    full = lambda rows: links_of(jobs.located_text(spark.createDataFrame(rows, CHUNKS)).collect())
    first = pages(10)
    put(spark, path, 0, first)
    assert links_of(run().collect()) == full(first) and seen == [list(range(10))]
    assert links_of(run().collect()) == full(first) and len(seen) == 1  # nothing new: nothing read
    edited = [chunk("https://new.org/4", doc=4), chunk("no link any more", doc=5), chunk("https://x.org/77", doc=77)]
    put(spark, path, 1, [*edited, *[r for r in first if r[0] == 6][::-1]])
    now = [r for r in first if r[0] not in (4, 5)] + edited
    got = run()
    assert links_of(got.collect()) == full(now) and seen[1:] == [[4, 5, 77]]  # page 6 came again as it was
    files = [f for f in got.inputFiles()]
    assert files and all("/in/" not in f for f in files)
    put(spark, path, 2, edited)  # delivered twice
    assert links_of(run().collect()) == full(now) and seen[2:] in ([[]], [])
    put(spark, path, 3, [chunk("https://a.org", doc=1)])
    put(spark, path, 4, [chunk("https://b.org", doc=1), chunk(None, doc=2)])
    last = [r for r in now if r[0] not in (1, 2)] + [chunk("https://b.org", doc=1)]
    assert links_of(run().collect()) == full(last)
    none = spark.createDataFrame([(77, 1, "Link", None, 72.0, 700.0, 200.0, 12.0)], ANNOTATIONS)
    assert [r.doc_id for r in incremental.relink_changes(spark, f"{path}/in", state, none, parts=4).where("status = 'already_linked'").collect()] == [77]


def test_a_run_that_was_cut_off(spark, tmp_path, monkeypatch):
    path, state = str(tmp_path), str(tmp_path / "state")
    put(spark, path, 0, pages(4))
    real = incremental._replace

    def broken(rows, where):
        if where.endswith("ledger"):
            raise OSError("gone")
        real(rows, where)

    monkeypatch.setattr(incremental, "_replace", broken)
    with pytest.raises(OSError):
        incremental.scan_changes(spark, f"{path}/in", state, parts=2)
    monkeypatch.undo()
    got = incremental.scan_changes(spark, f"{path}/in", state, parts=2)
    assert links_of(got.collect()) == links_of(jobs.located_text(spark.createDataFrame(pages(4), CHUNKS)).collect())


def test_hashes_tell_contents(spark):
    one = spark.createDataFrame(pages(1), CHUNKS)
    of = lambda df: incremental.content_hashes(df).first().content
    assert of(one) == of(one.orderBy(F.desc("seq")).repartition(3))
    assert len({of(one), of(one.where("seq < 5")), of(one.withColumn("left_pt", F.col("left_pt") + 1)), of(one.unionByName(one))}) == 4
