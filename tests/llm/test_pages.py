"""Main text of pages made from templates whose articles are known."""

import random

import pytest

from linkfield.llm.html_wrapper import aligned, article_text, extract_main_text, host_paths, parse, pattern


def prose(draw, n):
    return " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(100_000)}" for _ in range(n))


def alone(pages):
    """What wrappers say, without counted blocks."""
    wrapper = pattern(parse(pages[0]))
    for p in pages[1:]:
        wrapper = aligned(wrapper, pattern(parse(p)))
    paths = frozenset(host_paths(wrapper))
    return [article_text(p, paths) for p in pages]


def site(draw, n, parts):
    """n pages: (html, article). parts: what the host's template has around and in its articles."""
    teasers = [prose(draw, 12) for _ in range(6)]
    tagged, pages = draw.random() < 0.7, []
    for k in range(n):
        blocks = [("h1", prose(draw, 5)), *(("p", prose(draw, draw.randrange(8, 40))) for _ in range(draw.randrange(1, 6)))]
        inner = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
        comments = "".join(f"<div class='comment'><p>{prose(draw, 40)}</p></div>" for _ in range(draw.randrange(1, 9)))
        after = {
            "comments": f"<div class='comments'>{comments}</div>", "related": "<div class='related'>" + "".join(f"<p><a href=x>{t}</a> {t}</p>" for t in draw.sample(teasers, 3)) + "</div>",
            "newsletter": f"<div class='newsletter'><p>{teasers[0]} {teasers[1]} {teasers[2]}</p><form><input></form></div>", "svg": "<svg><path d=x>", "video": "<video src=x>", "iframe": "<iframe src='y'>",
            "script": "<script>var a = '<p>not text</p>'</script><style>p {}</style>",
        }
        late = "<p>" + prose(draw, 9) + "</p>" if {"svg", "video", "iframe"} & set(parts) else ""
        tail = late[3:-4]
        body = inner + "".join(after[x] for x in parts if x in after) + late
        body = f"<article>{body}</article>" if tagged else f"<div class='post'>{body}</div>"
        side = f"<aside>{teasers[3]}</aside><div class='sidebar'><p>{prose(draw, 30)}</p></div>" if "sidebar" in parts else ""
        body = "<div>" * parts.get("deep", 0) + f"<ul>{''.join(f'<li><a href={i}>go {i}</a></li>' for i in range(8))}</ul>" + body + "</div>" * parts.get("deep", 0)
        if "form" in parts:
            body = f"<form id='page-form'>{body}</form>"
        html = f"<html><head><title>{k}</title></head><body><header><h2>{teasers[4]}</h2></header><nav><a href=x>home</a></nav>{body}{side}<footer>{teasers[5]}</footer></body></html>"
        pages.append((html, "\n".join([*(x for _, x in blocks), *([tail] if tail else [])]), tagged))
    return pages


CASES = [("comments",), ("related",), ("newsletter",), ("sidebar", "script"), ("svg",), ("video",), ("iframe",), ("form",), ("comments", "form", "sidebar"), ("comments", "related", "newsletter", "sidebar", "script")]


@pytest.mark.parametrize("depth", [0, 45, 120])
def test_articles_of_made_sites(spark, depth):
    draw = random.Random(depth)
    rows, want, k = [], {}, 0
    for h, parts in enumerate(CASES):
        for html, article, tagged in site(draw, 14, dict.fromkeys(parts, 1) | {"deep": depth}):
            rows.append((k, f"http://h{h}.org/{k}", html))
            if tagged:
                want[k] = article
            k += 1
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and want
    wrong = [(CASES[i // 14], got[i], want[i]) for i in want if got[i] != want[i]]
    assert not wrong, wrong[:2]


def test_comments_longer_than_the_article_go():
    draw = random.Random(5)
    page = lambda box, n: f"<body><article><h1>{prose(draw, 3)}</h1><p>short text here</p><div class='{box}'>{''.join(f'<p>{prose(draw, 50)}</p>' for _ in range(n))}</div></article></body>"
    for box in ("comments", "related", "newsletter"):
        assert all(t.count("\n") == 1 and t.endswith("short text here") for t in alone([page(box, 6) for _ in range(12)]))
    whole = [f"<body><div class='promo'><h1>{prose(draw, 3)}</h1><p>{prose(draw, 60)}</p></div><p>hello</p></body>" for _ in range(5)]
    assert all(t.count("\n") >= 1 for t in alone(whole))  # by its slots this one is the article, whatever it is called


def test_unclosed_elements_keep_the_rest():
    for odd in ("<svg><path d=x>", "<video src=x>", "<iframe src=x>", "<script src=x>", "<select>"):
        assert article_text(f"<article><p>a {odd} b</p><p>rest</p></article>", frozenset(["#/article"])).endswith("rest")
    kept = "<article><p>x <math><mi>y</mi></math> <noscript>n</noscript> <object>o</object></p><video><p>fallback</p></video><svg><text>s</text></svg><p>z</p></article>"
    assert article_text(kept, frozenset(["#/article"])) == "x y n o\nz"


def test_lines_that_take_turns_stay(spark):
    draw = random.Random(6)
    rows = [(k, f"http://r.org/{k}", f"<body><article><h1>{prose(draw, 4)}</h1><p>{prose(draw, 30)}</p><div class=verdict>{'Recommended.' if k % 5 < 3 else 'Not recommended.'}</div><div class=notice2>All rights are kept.</div></article></body>") for k in range(20)]
    got = [r.text.split("\n") for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert [t[2:] for t in got] == [["Recommended." if k % 5 < 3 else "Not recommended."] for k in range(20)]


def test_scripts_end_where_their_end_tag_stands():
    of = lambda x: article_text(f"<article>{x}</article>", frozenset(["#/article"]))
    for script in ("<script>x<y</script>", "<SCRIPT a='>'>if (a<b) {'</p>'}</Script\n>", "<style>p > a {}</style>", "<textarea><p>q</textarea>", "<script/>"):
        assert of(f"<p>a{script}b</p>c") == "ab\nc"
    assert of("a<script>x") == "ax"
