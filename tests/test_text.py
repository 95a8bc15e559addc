"""Column functions over text."""

import pytest
from pyspark.sql import functions as F

from linkfield.functions.text import BARE_URL, SCHEME_URL, bare_tld, default_uri_filter, is_blank, matches, trim_trailing_punctuation


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_default_uri_filter(spark):
    cases = {
        "https://example.com/a": "https://example.com/a", " https://example.com ": "https://example.com", "mailto:a@b.c": "mailto:a@b.c", "tel:+123": "tel:+123",
        "www.example.com/promo": "https://www.example.com/promo", "WWW.x.y": "https://WWW.x.y", "https://": None, "http:example.com": None, "plain text": None,
        "BEGIN:VCARD\nN:x": None, "c:\\temp": None, "https://a/%zz": None, "https://a/%20": "https://a/%20", "www": None, "": None, "a|b:c": None, "WIFI:S:n;;": "WIFI:S:n;;",
    }
    assert column(spark, [*cases, None], default_uri_filter) == [*cases.values(), None]


def test_trailing_punctuation(spark):
    cases = {
        "https://e.com/x),": "https://e.com/x", "https://e.com/Foo_(bar)": "https://e.com/Foo_(bar)", "a.b).": "a.b", "((x)))": "((x))", "x]}!?": "x", "...": "", "": "", "a'\"": "a", "[x](y)": "[x](y)",
    }
    assert column(spark, [*cases, None], trim_trailing_punctuation) == [*cases.values(), None]


def found(spark, pattern, text):
    return [(m.start_off, m.value) for m in column(spark, [text], lambda c: matches(c, pattern))[0]]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Visit https://example.com/hello today.", [(6, "https://example.com/hello")]),
        ("xwww.a.b and HTTP://c.d", [(1, "www.a.b"), (13, "HTTP://c.d")]),
        ("www. https://", []),
        ("www.a.b\u00a0c", [(0, "www.a.b")]),
        ('<a href="https://q/r">', [(9, "https://q/r")]),
        ("", []),
    ],
)
def test_scheme_matches(spark, text, expected):
    assert found(spark, SCHEME_URL, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Get the app: qrco.de/trails-end", [(13, "qrco.de/trails-end")]),
        ("See section 3.14/2", []),
        ("Requires v1.2/beta", []),
        ("a@qrco.de/x", [(2, "qrco.de/x")]),
        ("v1.2.io/x", [(0, "v1.2.io/x")]),
    ],
)
def test_bare_matches(spark, text, expected):
    assert found(spark, BARE_URL, text) == expected


def test_tld_and_blank(spark):
    assert column(spark, ["qrco.DE/x.com/y", "v1.2.io/x"], bare_tld) == ["de", "io"]
    assert column(spark, ["", " \t\u00a0\u2003", "x", " x "], is_blank) == [True, True, False, False]
