"""Pages and lines with very many candidates, links, matches: the same rows as by the plain rules."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from linkfield.functions.geometry import corners, same_spot
from linkfield.functions.text import n_up_to
from linkfield.operators import dedupe
from linkfield.operators.dedupe import dedupe_text_spots, kept_rows
from linkfield.operators.existing import link_blocks, split_existing
from linkfield.operators.report import letter_findings, link_messages, numbered, ordered_results
from linkfield.options import ScanOptions
from linkfield.plans import jobs


def fold(boxes, text):
    """Keep-first, box by box."""
    kept = []
    for i, (x0, y0, x1, y1) in enumerate(boxes):
        for k in kept:
            a0, b0, a1, b1 = boxes[k]
            w, h = min(x1, a1) - max(x0, a0), min(y1, b1) - max(y0, b0)
            if text and w > 0.5 * min(x1 - x0, a1 - a0) and abs((y0 + y1) / 2 - (b0 + b1) / 2) < max(y1 - y0, b1 - b0):
                break
            smaller = min((x1 - x0) * (y1 - y0), (a1 - a0) * (b1 - b0))
            if not text and smaller > 0 and w > 0 and h > 0 and w * h > 0.5 * smaller:
                break
        else:
            kept.append(i)
    return kept


side = st.one_of(st.sampled_from([0.0, 0.05, 1.0, 8.0, 12.0, 100.0, 3000.0]), st.floats(0, 400))
boxes_ = st.lists(st.tuples(st.integers(-60, 60), st.integers(-30, 30), side, side).map(lambda b: (b[0] * 5.0, b[1] * 4.0, b[0] * 5.0 + b[2], b[1] * 4.0 + b[3])), max_size=60)


@settings(max_examples=200, deadline=None)
@given(boxes_, st.booleans())
def test_grid_keeps_what_the_fold_keeps(boxes, text):
    assert kept_rows(np.array(boxes, float).reshape(-1, 4), text) == fold(boxes, text)


@pytest.mark.parametrize("text", [True, False])
def test_grid_on_random_boxes_of_many_sizes(text):
    rng = np.random.default_rng(6)
    w, h = np.exp(rng.uniform(-3, 6, 1500)), np.exp(rng.uniform(-3, 5, 1500))
    x, y = rng.uniform(-300, 600, 1500), rng.uniform(-100, 800, 1500)
    boxes = np.stack([x, y, x + w, y + h], axis=1)
    assert kept_rows(boxes, text) == fold(boxes.tolist(), text)
    boxes[7] = boxes[7][[2, 1, 0, 3]]  # inside out
    assert kept_rows(boxes[:200], text) == fold(boxes[:200].tolist(), text)


def test_100_000_candidates_on_a_page(spark):
    rng = np.random.default_rng(1)
    n = 100_000
    at, row = rng.integers(0, 600, n) * 100.0, rng.integers(0, 100, n) * 20.0
    rows = pd.DataFrame({"doc_id": 1, "page_number": 1, "line_no": np.arange(n), "is_bare": 0, "match_no": 0, "uri": "u", "left_pt": at, "bottom_pt": row, "width_pt": 80.0, "height_pt": 12.0})
    got = [r.line_no for r in dedupe_text_spots(spark.createDataFrame(rows)).select("line_no").collect()]
    first = rows.groupby(["left_pt", "bottom_pt"])["line_no"].min()  # places are apart: the first of each stays
    assert sorted(got) == sorted(first.tolist()) and len(got) > 40_000


def page_boxes(spark, rng, n, pages, wide, tall=30):
    side = lambda most: np.round(rng.uniform(0, most, n))
    return spark.createDataFrame(pd.DataFrame({"doc_id": rng.integers(0, pages, n), "page_number": 1, "left_pt": side(560), "bottom_pt": side(780), "width_pt": side(wide), "height_pt": side(tall)}))


@pytest.mark.parametrize("most", [1, 7, 64])
def test_existing_links_by_blocks(spark, most):
    rng = np.random.default_rng(4)
    found = page_boxes(spark, rng, 1500, 20, 200).withColumn("k", F.monotonically_increasing_id())
    links = page_boxes(spark, rng, 3000, 25, 150).unionByName(page_boxes(spark, rng, 40, 25, 560, 700))
    got = {r.k: r.status for r in split_existing(found, links, most).collect()}
    pairs = found.withColumn("a", corners()).join(links.select("doc_id", corners().alias("b")), "doc_id").where(same_spot(F.col("a"), F.col("b")))
    want = {r.k for r in pairs.select("k").distinct().collect()}
    assert len(got) == 1500 and {k for k, s in got.items() if s == "already_linked"} == want and 100 < len(want) < 1400
    sizes = link_blocks(links, most).select(F.size("links").alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert sizes[0] <= most and sizes[1] == links.where("width_pt > 0 and height_pt > 0").count()


def test_100_000_links_on_a_page(spark):
    n = 100_000
    at = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_number"), ((F.col("id") % 100) * 100.0).alias("left_pt"), (F.floor(F.col("id") / 100) * 20.0).alias("bottom_pt"), F.lit(80.0).alias("width_pt"), F.lit(12.0).alias("height_pt"), "id")
    found = at.where("id % 10 = 0").withColumn("bottom_pt", F.col("bottom_pt") + F.when(F.col("id") % 20 == 0, 5.0).otherwise(7.0))
    got = split_existing(found, at.drop("id"))
    assert {(r.id % 20, r.status): r.n for r in got.groupBy((F.col("id") % 20).alias("id"), "status").agg(F.count("*").alias("n")).collect()} == {(0, "already_linked"): 5000, (10, "linked"): 5000}


def test_10_000_matches_and_chunks_in_a_line(spark):
    n = 10_000
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("see https://e"), "id", F.lit(".com/x."))).otherwise(F.concat(F.lit("and q"), "id", F.lit(".de/y,")))
    box = [(F.col("id") * 20.0).alias("left_pt"), F.lit(700.0).alias("bottom_pt"), F.lit(15.0).alias("width_pt"), F.lit(12.0).alias("height_pt"), F.lit(3.0).alias("space_width")]
    chunks = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_number"), F.lit(0).alias("source_rank"), F.lit(0).alias("tile_y"), F.col("id").cast("int").alias("seq"), text.alias("text"), *box)
    got = {r.uri: (r.left_pt, r.width_pt) for r in jobs.text_candidates(chunks, ScanOptions(match_bare_domains=True)).collect()}
    assert got == {f"https://e{i}.com/x" if i % 2 == 0 else f"https://q{i}.de/y": (20.0 * i, 15.0) for i in range(n)}


def test_binary_search(spark):
    values = F.array(*[F.lit(v) for v in (1, 3, 3, 8)])
    found = lambda most: n_up_to(F.size(values), lambda i: F.get(values, i), F.lit(most))
    none = F.expr("array()").cast("array<int>")
    row = spark.range(1).select(*[found(m) for m in (0, 1, 2, 3, 7, 8, 99)], n_up_to(F.size(none), lambda i: F.get(none, i), F.lit(5))).first()
    assert list(row) == [0, 1, 1, 3, 3, 4, 4, 0]


def test_numbers_are_those_of_a_window(spark):
    rng = np.random.default_rng(9)
    n = 4000
    rows = pd.DataFrame({"doc_id": rng.integers(0, 4, n) ** 2, "page_number": rng.integers(1, 3500, n), "bottom_pt": rng.integers(0, 5, n) * 10.0, "status": rng.choice(["linked", "already_linked"], n), "source_rank": rng.integers(0, 2, n), "order_key": np.arange(n), "uri": "u"})
    links = spark.createDataFrame(rows)
    new = F.when(F.col("status") == "linked", 0).otherwise(1)
    whole = Window.partitionBy("doc_id")
    by_window = links.select("order_key", F.row_number().over(whole.orderBy("page_number", F.desc("bottom_pt"), new, "source_rank", "order_key")).alias("a"), F.row_number().over(whole.orderBy("source_rank", "page_number", "order_key")).alias("b"), F.row_number().over(whole.orderBy(new, "source_rank", "page_number", "order_key")).alias("c")).toPandas().set_index("order_key")
    assert {r.order_key: r.b for r in links.transform(ordered_results).withColumnRenamed("result_no", "b").collect()} == by_window["b"].to_dict()
    letters = {r.order_key: ord(r.letter) - 64 for r in letter_findings(links).collect()}
    assert letters == by_window["a"].to_dict()
    lines = [(r.doc_id, r.message_no, r.page_number) for r in link_messages(links).collect()]
    assert sorted(lines) == sorted((int(d), int(c), int(p)) for d, c, p in zip(rows["doc_id"], by_window["c"].loc[rows["order_key"]], rows["page_number"]))
    assert numbered(links.where("false"), "n", [], ["order_key"]).count() == 0


def test_small_and_large_groups_fold_alike(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = page_boxes(spark, rng, 400, 3, 120).select("*", F.monotonically_increasing_id().alias("line_no"), F.lit(0).alias("is_bare"), F.lit(0).alias("match_no"), F.lit("u").alias("uri"))
    folded = sorted(r.line_no for r in dedupe_text_spots(rows).collect())
    monkeypatch.setattr(dedupe, "FOLD_ROWS", 20)
    assert sorted(r.line_no for r in dedupe_text_spots(rows).collect()) == folded
