"""Rows that operators must bear: null and repeated ids, very long texts, ties, clashing names."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkfield.llm.fingerprint import fingerprint_edits
from linkfield.llm.line_dedup import drop_boilerplate_lines
from linkfield.llm.mixing import mix_sources
from linkfield.llm.token_output import encode_and_read_back
from linkfield.llm.tokens import encoder, tokenizer_path
from linkfield.llm.toxicity import toxicity, train
from linkfield.llm.url_filter import Rule, filter_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed=0):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(5000)}" for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_urls_of_rules_that_are_equally_long(spark):
    rules = [Rule("a.com", "/bb/", "block"), Rule("com", "/bb/bb", "allow"), Rule("x.a.com", "/", "allow")]
    long = "http://x.a.com/" + "p/" * 200_000
    df = spark.createDataFrame([("http://x.a.com/bb/bb",), (long,), ("http://" + "y." * 5000 + "a.com/bb/",)], "url string")
    got = [(r.rule, r.verdict) for r in filter_urls(df, "url", rules).collect()]
    assert got[0][0] in ("a.com/bb/", "com/bb/bb") and got[1:] == [("x.a.com/", "allow"), ("a.com/bb/", "block")]
    assert got[0] == (filter_urls(df, "url", rules[::-1]).collect()[0].rule, filter_urls(df, "url", rules[::-1]).collect()[0].verdict)


def test_mix_of_null_and_repeated_ids(spark):
    df = docs(spark, [(None, words(10, 1), "a"), (None, words(10, 1), "a"), (3, words(20, 2), "a"), (3, words(20, 2), None), (4, None, None), (4, "", "b")])
    got = mix_sources(df.repartition(3), weights=(5, 2, 1), max_epochs=3).collect()
    assert len(got) == 6 and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(df.repartition(2), weights=(5, 2, 1), max_epochs=3).collect()))


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = [(None, words(50, 1), "a"), (None, words(60, 2), "a"), (7, words(50, 3), "a"), (7, words(50, 3), "a"), (9, None, "a"), (11, words(90_000, 4), "b"), *[(20 + i, words(20, 50 + i), "c") for i in range(60)]]
    df = docs(spark, rows)
    got = {}
    for n in ("1", "4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got[n] = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in fingerprint_edits(df.repartition(5)).collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got["4"]) == len(rows) and got["1"] == got["4"] == got["40"]


def test_token_output_of_null_and_repeated_ids(spark):
    texts = [(5, words(30, 1)), (5, words(40, 2)), (5, words(30, 1)), (None, "x y"), (None, None), (1, words(100_000, 3)), (9, "")]
    df = spark.createDataFrame([(i, t, 3, "f") for i, t in texts], "doc_id long, text string, n int, frame string")
    enc = encoder(tokenizer_path(None))
    ids = {t: np.append(next(iter(enc.encode([t or ""]))), np.uint32(1)).astype("<u4") for _, t in texts}
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(ids[r[1]]), len(ids[r[1]])))
    want, at = [], 0
    for i, t in order:
        want.append((i, at, len(ids[t]), zlib.crc32(ids[t])))
        at += len(ids[t])
    for parts in (1, 5):
        assert sorted(map(tuple, encode_and_read_back(df.repartition(parts)).collect()), key=str) == sorted(want, key=str)


def test_line_dedup_and_toxicity_of_very_long_texts(spark):
    long = "\n".join(f"line {i} {words(8, i)}" for i in range(20_000))
    rows = [(i, f"own {i}\nfooter", "s") for i in range(40)] + [(100, long + "\nfooter", "s"), (101, words(200_000, 9) + " scum", None)]
    got = {r.doc_id: r for r in drop_boilerplate_lines(docs(spark, rows)).collect()}
    assert got[100].text == long and got[100].n_dropped == 1 and got[101].n_dropped == 0
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, toxic int")
    scored = toxicity(docs(spark, [(i, f"{words(30, i)} {'scum' if i % 2 else ''}", "s") for i in range(40)] + rows[40:]).select("doc_id", "text"), labels).collect()
    assert len(scored) == 42 and all(0 <= r.score <= 1 for r in scored)


def test_an_id_on_many_rows_is_one_row_of_the_fit(spark):
    df = docs(spark, [(1, f"{words(20, i)} scum", "s") for i in range(300)] + [(2, words(20, 900), "s"), (2, words(20, 901), "s"), (3, None, "s")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    one = docs(spark, [(i, t, "s") for i, t in df.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("t")).collect()])
    assert sorted(train(df.repartition(7), labels)) == sorted(train(one, labels))


def test_join_stage_with_clashing_columns_and_maps(spark):
    same = words(30, 1)
    rows = [(1, same, "s", 0, {"a": 1}, 5, "q"), (1, same, "s", 0, {"a": 0}, 5, "q"), (2, same, "s", 0, None, 6, "r"), (3, words(30, 2), "s", 0, {"b": 2}, 7, "t")]
    df = spark.createDataFrame([(i, t, "en", s, n, m, a, b) for i, t, s, n, m, a, b in rows], DOCS + ", m map<string,int>, of_id long, of_text string")
    got = corpus_pipeline.one_of_each_group(spark, df, "")
    assert got.columns == df.columns and sorted((r.doc_id, r.m["a" if r.doc_id == 1 else "b"]) for r in got.collect()) == [(1, 0), (3, 2)]


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", None)]])
def test_pipeline_without_texts_or_labels(spark, tmp_path, rows):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "777")
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(rows) and spark.conf.get(name) == "777"
    spark.conf.unset(name)
