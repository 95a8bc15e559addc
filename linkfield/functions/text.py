"""Column functions over text: white space, URL matches with their places, trimming, target filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The patterns of URLs and bare domains.
#: Unicode white space, spelt out: Java's \s knows ASCII only.
SPACE = r"\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
IN_URL = rf"[^{SPACE}<>\"']"

SCHEME_URL = rf"(?i)(?:https?://|www\.){IN_URL}+"

#: Labels of letters, digits and inner hyphens, each with its dot; then a top-level domain, a slash and the rest.
BARE_URL = rf"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z]{{2,24}}/{IN_URL}*"

# Top-level domains that a bare domain may end in.
TLDS = (
    "com net org info biz name pro mobi int edu gov mil "
    "io co me tv cc ai app dev page link site xyz online store tech cloud shop blog news live world today guide "
    "us uk ca de fr es it nl be ch at se no dk fi pl cz sk hu ro bg gr pt ie ru ua tr il sa ae "
    "cn jp kr hk tw sg my th vn ph in id au nz br mx ar cl pe za ng ke eg ly gl fm im to sh gg"
).split()

ABSOLUTE_URI = r"^[A-Za-z][A-Za-z0-9+.-]*:(?:[^\s\x00-\x1f<>\"{}|\\^`%]|%[0-9A-Fa-f]{2})+$"
WEB_SCHEME = r"^(?i)(?:https?|ftp):"
WEB_URI = r"^(?i)(?:https?|ftp)://[^/?#\s<>\"{}|\\^`%]+"

MATCHES = "array<struct<match_no:int,start_off:int,value:string>>"

# What is trimmed from the end of a URL.
MARKS = ".,;:!?\"'"
PAIRS = ((")", "("), ("]", "["), ("}", "{"))


def _of_one(text: Column, f: Callable[[Column], Column]) -> Column:
    """f(text), with text as an array's one element: it is worked out once and not in each of the places that refer to it,
    which makes code that is too long for the JVM to compile."""
    return F.get(F.transform(F.array(text), f), F.lit(0))


def trimmed(text: Column) -> Column:
    """text without white space around it.  Most texts are told by their first and last characters, without the pattern."""

    def one(t: Column) -> Column:
        bare = F.ascii(t).between(33, 126) & F.ascii(F.right(t, F.lit(1))).between(33, 126)
        return F.when(bare, t).otherwise(F.regexp_replace(t, rf"^[{SPACE}]+|[{SPACE}]+$", ""))

    return _of_one(text, one)


def is_blank(text: Column) -> Column:
    """White space alone.  Most texts are told by their first character, without the pattern."""
    return ~(F.ascii(text).between(33, 126) | text.rlike(rf"[^{SPACE}]"))


def default_uri_filter(text: Column) -> Column:
    """Absolute URIs as they are, www. hosts with https:// in front, null for the rest."""

    def target(t: Column) -> Column:
        absolute = t.rlike(ABSOLUTE_URI) & (~t.rlike(WEB_SCHEME) | t.rlike(WEB_URI))
        return F.when(absolute, t).when(F.lower(t).startswith("www."), F.concat(F.lit("https://"), t))

    return _of_one(trimmed(text), target)


def matches(text: Column, pattern: str) -> Column:
    """All matches, in order, as array<struct<match_no, start_off, value>>: the gaps between them give their places.

    One pass over matches and the gaps before them carries the place along."""
    both = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))

    def step(done: Column, x: Column) -> Column:
        one = F.struct(F.size(done["out"]).alias("match_no"), (done["at"] + x["gap"]).alias("start_off"), x["m"].alias("value"))
        return F.struct(F.array_append(done["out"], one).alias("out"), (done["at"] + x["gap"] + F.length(x["m"])).alias("at"))

    none = F.struct(F.expr("array()").cast(MATCHES).alias("out"), F.lit(0).alias("at"))
    return F.aggregate(F.filter(both, lambda x: x["m"].isNotNull()), none, step, lambda done: done["out"])


def n_up_to(n: Column, at: Callable[[Column], Column], most: Column) -> Column:
    """How many of n values in ascending order, given by place, are `most` or less: a binary search."""
    halve = lambda r: F.floor((r["low"] + r["high"]) / 2).cast("int")

    def step(r: Column, _: Column) -> Column:
        within = at(halve(r)) <= most
        narrower = F.struct(F.when(within, halve(r) + 1).otherwise(r["low"]).alias("low"), F.when(within, r["high"]).otherwise(halve(r)).alias("high"))
        return F.when(r["low"] < r["high"], narrower).otherwise(r)

    steps = F.array_repeat(F.lit(0), F.ceil(F.log2(n + F.lit(1.0))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), step, lambda r: r["low"])


def bare_tld(match: Column) -> Column:
    """The top-level domain of a bare match: what stands between the host's last dot and the first slash."""
    return F.lower(F.regexp_extract(F.substring_index(match, "/", 1), r"\.([A-Za-z]{2,24})$", 1))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def trim_trailing_punctuation(text: Column) -> Column:
    """Strips marks from the end, and closing brackets that the text has more of than opening ones."""
    run = F.length(F.regexp_extract(text, r"[.,;:!?\"')\]}]*$", 0))

    def step(s: Column, _: Column) -> Column:
        last = F.right(s, F.lit(1))
        strip = last.isin(*MARKS)
        for closer, opener in PAIRS:
            strip = strip | ((last == closer) & (_count(s, closer) > _count(s, opener)))
        return F.when(strip, F.left(s, F.length(s) - 1)).otherwise(s)

    ends = F.right(text, F.lit(1)).isin(*MARKS, *[closer for closer, _ in PAIRS])
    return F.when(ends, F.aggregate(F.array_repeat(F.lit(0), run), text, step)).otherwise(text)
