"""Registered queries on the smallest tables: SQL where there is some, the pipeline stage by stage."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkfield.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]}) q").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in queries.oracle_sql()])
def test_runs_over_whole_tables(spark, name):
    table, key = {"op4": ("embeddings", "vec_id"), "op5": ("pages", "page_id")}.get(name[:3], ("documents", "doc_id"))
    got = queries.queries()[name](spark, DATA)
    assert got.select(key).distinct().count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_pipeline_stages(spark, tmp_path):
    draw = random.Random(2)
    text = lambda n: " ".join(f"w{draw.randrange(3000)}" for _ in range(n))
    rows = [(i, text(50) + ("\nread more here" if i % 2 else "\nown line"), "en", f"s{i % 3}", 0) for i in range(150)]
    rows += [(200, rows[4][1], "en", "s0", 0), (201, rows[4][1].replace("own", "my"), "en", "s1", 0), (202, None, "en", "s0", 0), (203, "you scum", "en", None, 0)]
    rows += [(300 + i, text(40) + " scum", "en", "s1", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert all(s.columns == docs.columns for s in seen[:-1])
    assert not {i for i in ids[1] if i >= 300} and {i for i in ids[0] if i < 200} <= ids[1] and 202 in ids[1]
    assert ids[2] == ids[1] and seen[2].where("text like '%read more here%'").count() == 0
    assert seen[2].where("n_chars <> length(text)").count() == 0
    assert ids[3] == ids[2] - {200, 201}
    counts = {r.doc_id: r.n for r in seen[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(counts) <= ids[3] and max(counts.values()) <= 3
    last = seen[5]
    assert sum(counts.values()) == last.where("piece = 0").count()
    total = last.agg(F.sum("length")).first()[0]
    assert last.select("sequence_id").distinct().count() <= math.ceil(total / 2048) + 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == last.count()


def test_join_stage_keeps_one_of_each_group_by_text(spark):
    text = lambda k, n=30: " ".join(f"v{k}x{i}" for i in range(n))
    same = text(1)
    rows = [(3, same, "s1"), (5, same.upper(), "s1"), (5, text(2), "s1"), (7, text(3), "s1"), (7, text(3), "s1"), (8, text(4), "b"), (8, text(4), "a")]
    rows += [(None, text(5), "s1"), (9, text(5), "s1"), (None, text(6), "s1"), (None, text(6), "s1"), (11, None, "s1"), (11, "", "s1"), (12, None, "s1")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text, r.source) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()), key=str)
    want = [(3, same, "s1"), (5, text(2), "s1"), (7, text(3), "s1"), (8, text(4), "a"), (9, text(5), "s1"), (None, text(6), "s1"), (11, None, "s1"), (11, "", "s1"), (12, None, "s1")]
    assert got == sorted(want, key=str)
    assert corpus_pipeline.one_of_each_group(spark, docs.where("false"), "").count() == 0
