"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkfield.llm.components import components
from linkfield.llm.embedding_dedup import collision, near_duplicates, plan, unlike_signs
from linkfield.llm.fingerprint import fingerprint_edits, merge, resemblance, with_bottom_k
from linkfield.llm.hashing import shingle_sets
from linkfield.llm.html_wrapper import aligned, article_paths, article_text, digest, extract_main_text, parse, pattern
from linkfield.llm.line_dedup import drop_boilerplate_lines
from linkfield.llm.mixing import mix_sources, mixed_documents
from linkfield.llm.ngram_join import RTree, jaccard_components, linked
from linkfield.llm.packing import LocalSearch, best_fit_decreasing, pack, pack_documents
from linkfield.llm.token_output import Shard, ShardReader, read_token_shards, token_digests, train_dictionary, write_token_shards
from linkfield.llm.tokens import HashTable, WordEncoder, tokenizer_path
from linkfield.llm.toxicity import Settings, drop_toxic, feature_sets, fit_ftrl, score, toxicity, train
from linkfield.llm.url_filter import Rule, build_cascade, filter_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = "[^\x20\x09-\x0D]+"


def docs(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def words(n, seed=0, vocabulary=5000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


# 1 URL filter


def test_urls(spark):
    rules = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow")]
    urls = {
        "http://Example.COM/en/x": ("example.com", "/en/x", "example.com/en/", "block"), "http://a.www.example.com/en/?q": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://com": ("com", "", None, "allow"), "x://e.org#f": ("e.org", "", None, "allow"),
        "no url": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://ÉX.com/É": ("Éx.com", "/É", "com/", "allow"),
    }
    df = spark.createDataFrame([(u, "mine", "r") for u in [*urls, "http://com"]], "url string, host string, rule string")
    got = filter_urls(df, "url", rules).collect()
    assert len(got) == len(urls) + 1
    assert all((r.host, r.path, r.rule, r.verdict) == urls[r.url] for r in got)
    assert filter_urls(df.where("false"), "url", rules).count() == 0 and filter_urls(df, "url", []).where("verdict = 'block'").count() == 0


def test_cascade_is_exact(spark):
    listed = spark.range(300).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = build_cascade(listed, universe, rate=0.3)
    assert len(cascade.levels) > 2
    got = universe.where(cascade.contains(F.col("key"))).collect()
    assert {r.key for r in got} == {f"k{i * 7}" for i in range(300)}


# 2 mixing


def test_mix(spark):
    rows = [(i, words(10 + i % 7, i), "a") for i in range(40)] + [(100 + i, words(300, i), "b") for i in range(20)] + [(200 + i, "x y", None) for i in range(5)] + [(300, None, "c"), (301, "", "a")]
    df = docs(spark, rows).withColumn("size", F.lit(-1))
    got = mix_sources(df).collect()
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    assert len(got) == len(rows)
    target = {r.source: r.target for r in got}
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert target["a"] == 3 * sizes["a"] and target["c"] == 0  # clamped; a source without words
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert all(abs(taken[s] - target[s]) <= max((len((t or "").split()) for _, t, x in rows if x == s)) for s in target)
    assert sorted(map(tuple, mix_sources(df.repartition(5)).collect()), key=str) == sorted(map(tuple, got), key=str)
    repeats = Counter(r.doc_id for r in mixed_documents(df).collect())
    assert all(repeats[r.doc_id] == r.repeats for r in got)
    assert mix_sources(df.where("false")).count() == 0 and mixed_documents(df.where("false")).count() == 0


# 3 n-gram join


def brute_components(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(SPACE, (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_ngram_join(spark):
    draw, texts = random.Random(1), {}
    for g in range(12):
        base = words(40 + 25 * g, g).split()
        for k in range(6):
            copy = list(base)
            for _ in range(k):
                copy[draw.randrange(len(copy))] = f"e{draw.randrange(10**6)}"
            texts[g * 10 + k] = " ".join(copy)
        texts[g * 10 + 6] = texts[g * 10].upper()
    passage = words(60, 99)
    for k in range(40):
        texts[500 + k] = words(30, 1000 + k) + " " + passage + "\n" + words(20, 2000 + k)
    texts |= {900: None, 901: "", 902: " \n\t", 903: "One two", 904: "one  TWO", 905: "two one", 906: "a " * 3000, 907: "a " * 50, 908: "É b c d e", 909: "é b c d e"}
    df = docs(spark, [(i, t, "s") for i, t in texts.items()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df.withColumn("node", F.lit(1))).collect()}
    assert got == brute_components(texts)
    again = jaccard_components(df.unionByName(docs(spark, [(None, "one two", "s"), (903, "One two", "s")]))).collect()
    assert len(again) == len(texts) + 2 and [r.component_id for r in again if r.doc_id is None] == [903]
    assert jaccard_components(df.where("false")).count() == 0


def test_ngram_join_with_common_shingles(spark):
    """A large group of near copies: its shingles count as common, its cells come in parts."""
    draw, base, texts = random.Random(8), words(70, 1).split(), {}
    for k in range(300):
        copy = list(base)
        for _ in range(draw.randrange(12)):
            copy[draw.randrange(70)] = f"e{draw.randrange(40)}"
        texts[k] = " ".join(copy)
    for k in range(40):
        texts[400 + k] = " ".join(base[: 30 + k]) + " " + words(40 - k, k)
    df = docs(spark, [(i, t, "s") for i, t in texts.items()]).repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()} == brute_components(texts)


def test_tree_join_loses_nothing():
    draw = np.random.default_rng(0)
    base = draw.poisson(3, (30, 16))
    points = np.concatenate([np.clip(base + draw.integers(-1, 2, base.shape) * (draw.random(base.shape) < 0.2), 0, None) for _ in range(5)]).astype(np.uint16)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = RTree(points, sizes)
    i, j = tree.join(tree)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for a in range(len(points)) for b in range(a + 1, len(points)) if linked(np.minimum(points[a], points[b]).sum(), sizes[a] + sizes[b])}
    assert got == want and want
    i, j = RTree(points[:60], sizes[:60]).join(RTree(points[60:], sizes[60:]))
    assert {(a, b + 60) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a, b in want if a < 60 <= b}


def test_shingle_sets_over_windows(monkeypatch):
    from linkfield.llm import hashing

    texts = [words(300, 1), "x" * 500 + " y z " + "q" * 300, "", "Ab cD"]
    whole = shingle_sets(texts)
    monkeypatch.setattr(hashing, "WINDOW", 64)
    assert all((a == b).all() for a, b in zip(whole, shingle_sets(texts), strict=True))


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)] + [(7, 7)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    links = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {r.node: r.component for r in components(links, few=0).collect()}
    linked_nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: label[x] for x in linked_nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == components(links.where("false"), few=-1).count() == 0


# 4 embeddings


def test_embeddings(spark):
    draw = np.random.default_rng(2)
    base = draw.standard_normal((40, 32))
    x = np.concatenate([base + draw.standard_normal(base.shape) * s for s in (0, 0.1, 0.3, 0.5)] + [np.repeat(base[:1], 30, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [None] * 32), (1004, [float("nan")] * 32), (1005, [float("inf")] + [0.0] * 31), (1006, [1.0, 0.0]), (1007, [2.0, 0.0]), (1008, [1e300] * 32), (None, base[1].tolist())]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows + odd], "vec_id long, embedding array<double>, n long")
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    for i in range(len(x)):
        assert got[i].n_links == near[i].sum() - 1 + near[i, 1]  # the row without an id equals vector 1
        assert got[i].kept == (got[i].component_id == i)
    assert got[1006].component_id == got[1007].component_id == 1006 and got[1007].n_links == 1
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1006))
    assert near_duplicates(df.where("false")).count() == 0


def test_embeddings_against_all_pairs(spark):
    draw = np.random.default_rng(9)
    base = draw.standard_normal((300, 48))
    hot = draw.standard_normal(48) + draw.standard_normal((700, 48)) * 0.25  # one group of a third of all rows
    x = np.concatenate([base, hot, *(base + draw.standard_normal(base.shape) * s for s in (0.2, 0.3, 0.35))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    assert len(i) > 100_000
    want = np.bincount(np.concatenate([i, j]), minlength=len(x))
    for block in (16384, 100):  # buckets whole, and block by block
        got = {r.vec_id: r for r in near_duplicates(df, block=block).collect()}
        links = np.array([got[k].n_links for k in range(len(x))])
        assert (links <= want).all() and links.sum() >= 0.998 * want.sum()
        for a in range(len(x)):
            assert got[a].component_id <= a and got[a].kept == (got[a].component_id == a)
        assert len({got[k].component_id for k in range(300, 1000)}) == 1
        assert sum(got[a].component_id == got[b].component_id for a, b in zip(i.tolist(), j.tolist(), strict=True)) >= 0.999 * len(i)


def test_sketches_rule_out_few_pairs_at_the_threshold():
    draw = np.random.default_rng(1)
    a, b = draw.standard_normal((2, 20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    signs = draw.standard_normal((64, 128))
    unlike = ((a @ signs > 0) != ((0.9 * a + math.sqrt(1 - 0.81) * b) @ signs > 0)).sum(axis=1)
    assert (unlike > unlike_signs(0.9)).sum() <= 4 and ((a @ signs > 0) != (b @ signs > 0)).sum(axis=1).min() > unlike_signs(0.9) - 6
    assert unlike_signs(1.0) == 0 and unlike_signs(-1.0) == 128


def test_embedding_plan():
    assert 0.79 < collision(math.sqrt(0.2)) < 0.81 and collision(0.01) > 0.99
    for n in (0, 10, 10**4, 10**8):
        k, tables = plan(n, 0.9)
        assert (1 - collision(math.sqrt(0.2)) ** k) ** tables <= 0.002


# 5 HTML


def test_extraction(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav>{}<footer>foot</footer></body></html>"
    bodies = {
        "<article><h1>A &amp; B</h1><p><b>one\n two<br><p>three&nbsp;four<script>x<y</script></p><!-- c --></article>": "A & B\none two\nthree four",
        '<div class="content"><h2>T</h2><p>first <i>word</i></p><ul><li>1<li>2</ul></div><div id="comments"><p>bad</p></div>': "T\nfirst word\n1\n2",
        "<main><p>x</p><aside>s</aside><form><p>f</p></form><div class='ad'>z</div></main>": "x",
        "": "",
    }
    rows = [(k, f"http://h{k}.org/p", page.format(b), "old") for k, b in enumerate(bodies)] + [(9, "http://h0.org/q", None, "old"), (10, None, "", "old")]
    got = {r.page_id: r for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert [got[k].text for k in range(4)] == list(bodies.values())
    assert got[9].text == got[10].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert article_text("<div>" * 3000 + "deep", frozenset()) == "deep" and article_text("<", frozenset()) == "<"


def test_wrappers_learn_optional_and_repeated_parts():
    a = pattern(parse("<body><div class=post-1><p>x<p>y</div><div class=foot>f</div></body>"))
    b = pattern(parse("<body><h1>t</h1><div class=post-22><p>z</div><div class=foot>f</div></body>"))
    both = aligned(a, b)
    kids = {k[0]: k for k in both[9][0][9]}
    assert kids["h1"][7] == 1 and kids["div.post-0"][9][0][8] == 1  # optional heading, repeated paragraph
    assert kids["div.foot"][6] == digest("f") and kids["div.post-0"][9][0][6] is None  # a constant, a slot
    assert article_paths(both) == ["#/body"]  # the heading is part of it


# 6 fingerprints


def test_fingerprints(spark):
    texts = {1: words(500, 1), 2: words(40, 2), 3: None, 5: "", 8: "two words", 9: words(500, 1), 11: "ünï " + words(300, 4)}
    rows = docs(spark, [(i, t, "s") for i, t in texts.items()]).withColumn("sketch", F.lit("mine"))
    got = {r.doc_id: r for r in fingerprint_edits(rows).collect()}
    order = sorted(texts)
    for k, i in enumerate(order):
        a, b = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert got[i].n_chars == len(a) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (x.split() for x in (a, b, edited))]
        j = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(got[i].near_edited - j(sets[0], sets[2])) < 0.2 and abs(got[i].near_next - j(sets[0], sets[1])) < 0.1
    assert got[1].fingerprint == got[9].fingerprint and got[3].fingerprint == got[5].fingerprint == ""
    assert fingerprint_edits(rows.where("false")).count() == 0 and fingerprint_edits(rows.where("doc_id = 2")).first().near_next == 1.0


def test_sketches_merge(spark):
    a, b = words(400, 1), words(300, 2)
    df = spark.createDataFrame([(a, b, f"{a} {b}")], "a string, b string, c string")
    for c in "abc":
        df = with_bottom_k(df, F.col(c), f"s{c}", 64)
    r = df.select(merge(F.col("sa"), F.col("sb"), 64).alias("m"), "sc", resemblance(F.col("sa"), F.col("sa")).alias("one")).first()
    assert len(set(r.m) & set(r.sc)) >= 62 and r.one == 1.0  # the four shingles across the seam may differ


# 7 packing


def test_packing(spark):
    texts = {i: words(5 + 37 * i % 900, i) for i in range(60)} | {100: None, 101: "", 102: words(6000, 7)}
    df = docs(spark, [(i, t, "s") for i, t in texts.items()] + [(5, texts[5], "s")]).withColumn("piece", F.lit(9))
    got = pack_documents(df, capacity=512).collect()
    enc = WordEncoder(tokenizer_path(None)).tokenizer
    want = Counter()
    for i, t in [*texts.items(), (5, texts[5])]:
        ids = np.array(enc.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.update((i, k, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512])) for k, a in enumerate(range(0, len(ids), 512)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and b[-1][0] + b[-1][1] <= 512
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 512) + 1
    assert pack_documents(df.where("false")).count() == 0


def test_groups_meet_again(spark):
    from linkfield.llm.packing import pack_pieces

    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 97 + 1).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    got = pack_pieces(pieces, 100, group_pieces=100)
    assert got.count() == 3000
    full = got.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.where("n > 100").count() == 0 and full.count() <= 1.04 * sum(i % 97 + 1 for i in range(3000)) / 100 + 2


def test_local_search_beats_best_fit():
    draw = np.random.default_rng(4)
    cases = [(np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6]), 60, 3)] + [(draw.integers(20, 50, 300), 100, None) for _ in range(3)]
    for _ in range(5):  # 60 bins are the least, since three lengths each fill one
        a, b = draw.integers(250, 400, (2, 60))
        cases.append((np.concatenate([a, b, 1000 - a - b]), 1000, 64))
    for x, capacity, most in cases:
        first, bins = best_fit_decreasing(x, capacity), pack(x, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(x))) and max(x[b].sum() for b in bins) <= capacity
        assert len(bins) < len(first) and (most is None or len(bins) <= most)
    for _ in range(20):
        x = draw.integers(1, 60, 80)
        bins = pack(x, 100)
        assert sorted(i for b in bins for i in b) == list(range(80)) and max(x[b].sum() for b in bins) <= 100 and len(bins) <= -(-x.sum() // 100) + 1
    assert pack(np.array([], np.int64), 10) == [] and len(pack(np.full(50, 10), 10)) == 50 and len(pack(np.full(50, 1), 10)) == 5


def test_steps_increase_squared_fill():
    draw = np.random.default_rng(5)
    x = draw.integers(20, 50, 60)
    search = LocalSearch(best_fit_decreasing(x, 100), x, 100)
    for e in range(len(search.bins)):
        while search.bins[e]:
            before = (search.fill.astype(float) ** 2).sum()
            if not search.step(e):
                break
            assert (search.fill.astype(float) ** 2).sum() > before and search.fill.max() <= 100
            assert [int(x[b].sum()) for b in search.bins] == search.fill.tolist()


# 8 token output


def test_token_shards(spark, tmp_path):
    texts = {i: words(50 + i, i) for i in range(40)} | {70: None, 71: "", 72: words(5000, 3), 73: "<|endoftext|> A, b."}
    rows = docs(spark, [(i, t, "s") for i, t in texts.items()]).repartition(5)
    write_token_shards(rows, str(tmp_path / "t"))
    enc, at = WordEncoder(tokenizer_path(None)).tokenizer, 0
    ids = {i: enc.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    for r in token_digests(spark, str(tmp_path / "t")).orderBy("doc_id").collect():
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4")))
        at += r.n_tokens
    assert at == sum(map(len, ids.values()))
    assert {r.doc_id: r.ids for r in read_token_shards(spark, str(tmp_path / "t"), [3, 72]).collect()} == {3: ids[3], 72: ids[72]}
    write_token_shards(rows.where("false"), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none" / "shards")).count() == 0


def test_shard_bytes():
    dictionary = train_dictionary([np.arange(400) % 50 for _ in range(200)], 2, 1024)
    import zstandard

    zstd = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    data = Shard([None, 4], [3, 0], [zstd.compress(np.array([1, 2, 3], "<u2").tobytes()), zstd.compress(b"")], 2).to_bytes(dictionary)
    reader = ShardReader(data, dictionary)
    assert reader.doc_ids == [None, 4] and reader.ids(0).tolist() == [1, 2, 3] and reader.ids(1).tolist() == []
    with pytest.raises(ValueError):
        ShardReader(data, b"another")


def test_words_encode_as_whole_texts(monkeypatch):
    from linkfield.llm import hashing

    texts = ["", "  ", "a,", "A.B.C.", "don't, won't. I'LL", "...", "x..", "<|endoftext|>, y<|startoftext|>", "ΣΑΣ, ΟΔΟΣ.", "İstanbul.", "été, \u0301x", "\x1ca\x1cb \x85 c", "日本語、テスト。", "ſtraße, ǅ!", "a" * 3000 + ",", "🙂,🙂 x?", "\tq\r\nz\x0b"]
    texts += ["×, ÷. é!!! ñ'", "it's' 'tis 'll' a'll'", "12,3. 4!?", "<|endoftext|>.", "x<|", "a‘, b’.", words(400, 3)]
    for window in (1 << 20, 16):
        monkeypatch.setattr(hashing, "WINDOW", window)
        for limit in (10**6, 3):  # that forgets all the time
            enc = WordEncoder(tokenizer_path(None), words=limit)
            for group in (texts, *[[t] for t in texts], texts, []):
                assert [x.tolist() for x in enc.encode(group)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in group]


def test_hash_table():
    table, h = HashTable(bits=3), np.random.default_rng(3).integers(1, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    h[:40] = np.arange(1, 41, dtype=np.uint64)  # all of them want one slot
    for a in range(0, 4000, 500):
        assert not table.find(h[a : a + 500])[1].any()
        table.add(h[a : a + 500], np.arange(a, a + 500), np.arange(a, a + 500) + 1)
    slot, known = table.find(h)
    assert known.tolist() == [True] * 4000 + [False] * 1000
    assert table.start[slot[:4000]].tolist() == list(range(4000)) and (table.length[slot[:4000]] == table.start[slot[:4000]] + 1).all()


# 9 line dedup


def test_lines(spark):
    rows = [(i, f"own {i}\nshared\n\n  footer  ", "a") for i in range(10)] + [(20 + i, "copy\nof one", "a") for i in range(9)] + [(40, "shared\nfooter", "b"), (41, None, "b"), (42, "", "b"), (43, "shared", None)]
    got = {r.doc_id: r for r in drop_boilerplate_lines(docs(spark, rows).withColumn("n_lines", F.lit(7)), max_ratio=0.3).collect()}
    assert all(got[i].text == f"own {i}\n" and got[i].n_dropped == 2 and got[i].n_lines == 4 for i in range(10))
    assert all(got[20 + i].text == "copy\nof one" for i in range(9))  # copies are one page
    assert got[40].text == "shared\nfooter" and got[41].text is None and got[42].text == "" and got[43].text == "shared"
    assert got[41].n_lines == 0 and got[42].n_lines == 1
    assert drop_boilerplate_lines(docs(spark, rows).where("false")).count() == 0


# 10 toxicity


def test_ftrl_finds_the_words():
    how = Settings(bits=16)
    clean = [words(60, i, 300) for i in range(400)]
    toxic = [words(40, 500 + i, 300) + " idiot, " + words(20, 900 + i, 300) for i in range(400)]
    sets = feature_sets([t for pair in zip(clean, toxic, strict=True) for t in pair], how)
    w = fit_ftrl(sets, [0, 1] * 400, how)
    fresh = feature_sets([words(60, 5000, 300), words(60, 5001, 300) + " IDIOT", ""], how)
    p = [1 / (1 + math.exp(-w[x].sum())) for x in fresh]
    assert p[0] < 0.7 < p[1] and p[2] < 0.7 and 0 < (w != 0).sum() < 2000


def test_scores(spark):
    rows = [(i, words(60, i, 300) + (" scum" if i % 3 == 0 else ""), "s") for i in range(600)] + [(900, None, "s"), (901, "", "s"), (902, words(40, 9, 300) + " Scum! " + words(40, 10, 300), "s")]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)] + [(None, 0, 1), (5, 1, None), (6, 0, 7)], "doc_id long, quality int, toxic int")
    weights = train(df, labels)
    got = {r.doc_id: r.score for r in score(df, weights).collect()}
    assert len(got) == len(rows) and all((got[i] >= 0.7) == (i % 3 == 0) for i in range(600))
    assert got[900] == got[901] < 0.7 <= got[902]
    kept = drop_toxic(df, weights)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i] < 0.7}
    only_bias = train(df, labels.where("false"))
    assert len(only_bias) == 1 and score(df.where("false"), only_bias).count() == 0


def plain_ftrl(sets, labels, how):
    """FTRL-proximal one coordinate at a time, in plain Python."""
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= how.l1:
            return 0.0
        return ((how.l1 if z[k] > 0 else -how.l1) - z[k]) / ((how.beta + math.sqrt(n[k])) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for x, y in zip(sets, labels, strict=True):
            g = 1 / (1 + math.exp(-sum(weight(k) for k in x))) - y
            for k, w in [(k, weight(k)) for k in x]:
                before = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / how.alpha * w
                n[k] = before + g * g
    return {k: weight(k) for k in z if weight(k)}


def test_toxicity_against_plain_python(spark):
    how = Settings(bits=12, epochs=2, l1=1.0)
    texts = [(i, words(12, i, 60) + (" scum" if i % 4 == 0 else "")) for i in range(60)]
    rows = texts + [(3, texts[3][1]), (None, "scum"), (100, None), (101, "")]
    df = spark.createDataFrame([(i, t, 0.5, 9) for i, t in rows], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    kept_out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    order = {r.doc_id: (r.o, r.h) for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(1)).alias("o"), F.xxhash64("doc_id").alias("h")).collect()}
    fitted = sorted(((*order[i], t, i) for i, t in rows if i is not None and i < 60 and not kept_out(i)))
    w = plain_ftrl([x.tolist() for x in feature_sets([t for _, _, t, _ in fitted], how)], [int(i % 4 == 0) for *_, i in fitted], how)
    got = toxicity(df, labels, how).collect()
    assert len(got) == len(rows)
    want = {t: 1 / (1 + math.exp(-sum(w.get(int(k), 0.0) for k in x))) for t, x in zip([t for _, t in rows], feature_sets([t or "" for _, t in rows], how), strict=True)}
    for r in got:
        text = {i: t for i, t in rows}[r.doc_id]
        assert r.held_out == kept_out(r.doc_id) and abs(r.score - want[text]) < 1e-5 and r.predicted == int(r.score >= 0.7)
    assert toxicity(df.where("false"), labels, how).count() == 0
