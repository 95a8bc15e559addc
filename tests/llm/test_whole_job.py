"""Planted cases that cut-down versions of the operators got wrong."""

from pyspark.sql import functions as F

import corpus_pipeline
from linkfield.llm import packing
from linkfield.llm.html_wrapper import aligned, article_text, extract_main_text, host_paths, outside, parse, pattern
from linkfield.llm.line_dedup import drop_boilerplate_lines


def test_boilerplate_in_small_and_large_sites(spark):
    rows = [(i, f"own {i}" + ("\nfooter" if i < 45 else "") + ("\nquoted" if i % 300 == 0 else ""), "en", "large", 0) for i in range(1500)]
    rows += [(2000 + i, f"mine {i}" + ("\nfooter" if i < 3 else "\nquoted" if i < 5 else ""), "en", "small", 0) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    judged = drop_boilerplate_lines(docs).groupBy("source").agg(F.sum("n_dropped").alias("n")).orderBy("source").collect()
    assert judged == [("large", 45), ("small", 3)]  # the production ratio: a site's footers, no more
    got = corpus_pipeline.without_boilerplate(spark, docs, "")
    assert got.count() == 1580 and got.where("text like '%footer%'").count() == 0  # 3 % and 3.75 %
    assert got.where("text like '%quoted%'").groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect() == [("large", 5), ("small", 2)]


def pieces(spark, n, length):
    zero = F.lit(0).cast("long")
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), zero.alias("start"), length.cast("long").alias("length"), zero.alias("ids_crc32"))


def test_pieces_that_share_no_sequence_stay_in_bounded_groups(spark, tmp_path, monkeypatch):
    real, log = packing.pack, str(tmp_path / "sizes")

    def counted(lengths, capacity):
        with open(log, "a") as f:
            f.write(f"{len(lengths)}\n")
        return real(lengths, capacity)

    placer = packing._placer

    def placing(*args):
        run = placer(*args)

        def place(key, rows):
            run.__globals__["pack"] = counted
            return run(key, rows)

        return place

    monkeypatch.setattr(packing, "_placer", placing)
    got = packing.pack_pieces(pieces(spark, 4000, F.lit(60)), 100, group_pieces=200).select("sequence_id").collect()
    sizes = [int(x) for x in open(log)]
    assert len(got) == len({r.sequence_id for r in got}) == 4000
    assert sum(sizes) >= 4000 and max(sizes) < 400


def extracted(pages):
    wrapper = pattern(parse(pages[0]))
    for p in pages[1:]:
        wrapper = aligned(wrapper, pattern(parse(p)))
    return [article_text(p, frozenset(host_paths(wrapper))) for p in pages]


def slug(i):
    return "".join(chr(97 + int(c)) for c in str(i))


def test_names_that_change_beyond_the_parts_of_a_sequence():
    page = "<body><div class='box-{0}'><article class='post x-{0}'><p>text {0}</p></article></div><div class='extra-{0}'>other</div><div class=promo>promo</div></body>"
    for n in (3, 120):
        assert extracted([page.format(slug(i)) for i in range(n)]) == [f"text {slug(i)}" for i in range(n)]


def test_end_tags_match_beyond_the_depth_of_wrappers():
    deep = "<div>" * 60 + "<p>deep</p>" + "</div>" * 60
    assert extracted([f"<body><article>{deep}<div class=nav>n</div><p>after</p></article><div>other</div></body>"] * 2) == ["deep\nafter"] * 2
    assert extracted(["<body><article>" + "<div>" * 60 + "<p>a</p><nav>n</nav>" + "</div>" * 60 + "</article></body>"]) == ["a"]


def test_names_that_only_mention_other_parts_keep_articles():
    for name in ("layout has-sidebar", "content no-sidebar", "post category-social-science", "modal"):
        page = "<body><nav>menu</nav><div class='" + name + "'><article><h1>t{0}</h1><p>text {0} of it</p></article></div><div class='site-footer'>f</div></body>"
        assert extracted([page.format(i) for i in range(3)]) == [f"t{i}\ntext {i} of it" for i in range(3)]
    assert article_text("<form><article><p>whole text</p></article></form>", frozenset(["#/html"])) == "whole text"
    apart = ("sidebar", "ad-12", "site-footer", "social-share", "x comments")
    assert all(outside(parse(f"<div class='{n}'>").children[0]) for n in apart)


def test_sibling_blocks_stay_where_there_is_no_article():
    page = "<body><div id=top><a href=x>home</a> <a href=y>more</a></div><div id=lead><p>lead {0}</p></div><div class='story'><p>a long text, number {0}</p><p>and more of it</p></div></body>"
    assert extracted([page.format(i) for i in range(3)]) == [f"lead {i}\na long text, number {i}\nand more of it" for i in range(3)]


def test_constants_of_a_host_are_left_out(spark):
    page = "<body><article><h1>title {0}</h1><p>first {0}</p><p>" + "All of our readers pay for this. " * 8 + "{1}</p><p>last {0}</p><p>Yours, the editors</p></article></body>"
    rows = [(i, "http://a.org/x", page.format(f"of {i}, which is a text of its own", "")) for i in range(12)]
    rows += [(20 + i, "http://b.org/x", page.format(f"of {i}", i)) for i in range(12)]  # the long texts differ at their ends
    rows += [(40 + i, "http://c.org/x", page.format("same", "")) for i in range(5)]  # one page
    rows += [(50 + i, "http://d.org/x", f"<body><article><h1>t{i}</h1><p>a copied article</p></article></body>") for i in range(5)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[20 + i] == f"title of {i}\nfirst of {i}\n{('All of our readers pay for this. ' * 8 + str(i))}\nlast of {i}" for i in range(12))
    assert all(got[i] == f"title of {i}, which is a text of its own\nfirst of {i}, which is a text of its own\nlast of {i}, which is a text of its own" for i in range(12))
    assert all("the editors" in got[40 + i] for i in range(5)) and all(got[50 + i] == f"t{i}\na copied article" for i in range(5))


def test_a_repeated_sentence_in_a_slot_is_content(spark):
    page = "<body><article><div class='box{0}'>Our terms apply.</div><p>text {0}</p><p>{1}</p></article></body>"
    rows = [(i, "http://a.org/x", page.format(i, "All rights reserved." if i % 5 == 0 else f"more of {i}")) for i in range(30)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text {i}\n" + ("All rights reserved." if i % 5 == 0 else f"more of {i}") for i in range(30))


def test_thousands_of_unlike_siblings():
    import time

    page = "<body><article><p>text {0}</p>" + "".join(f"<{'div' if k % 3 else 'p'} class='x{slug(k)}'>part {k} of {{0}}</{'div' if k % 3 else 'p'}>" for k in range(20_000)) + "</article><div class=promo>promo</div></body>"
    began = time.process_time()
    got = extracted([page.format(i) for i in range(3)])
    assert time.process_time() - began < 60
    assert [t.count("\n") for t in got] == [20_000] * 3 and all(t.startswith(f"text {i}\npart 0 of {i}") for i, t in enumerate(got))


def test_pages_are_read_alike_however_they_are_dealt(spark):
    page = "<html><body><div class=head><a href=x>home</a></div>{1}<div class='box-{2}'><article><h1>title {0}</h1><p>text {0}</p>{3}</article></div><div class=promo>Buy our things today</div></body></html>"
    rows = [(i, f"http://h{i % 2}.org/{i}", page.format(i, "<p>notice</p>" if i % 3 else "", slug(i), "<ul><li>a<li>b</ul>" if i % 5 else "")) for i in range(60)]
    rows += rows[:5] + [(90, "http://h0.org/x", None), (91, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, extract_main_text(df.coalesce(1)).collect()), key=str)
    assert len(want) == len(rows)
    assert sorted(map(tuple, extract_main_text(df.repartition(7)).collect()), key=str) == want
    assert extract_main_text(df.where("false")).count() == 0


def test_the_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from linkfield.llm.common import shared_dir

    unnamed = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(unnamed)
