"""Link candidates from lines of text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import BARE_URL, MATCHES, SCHEME_URL, TLDS, bare_tld, default_uri_filter, matches, n_up_to, trim_trailing_punctuation
from .lines import PAGE, computed_once

#: Spans of a line up to which those that a match touches are looked for one by one.
FEW_SPANS = 16


def scheme_url_matches(lines: DataFrame) -> DataFrame:
    """lines with scheme: matches of http://, https:// and www. with their places.

    A test for the few letters that every match has spares other lines the pattern."""
    low = F.lower("line_text")
    likely = low.contains("http") | low.contains("www.")
    return lines.withColumn("scheme", F.when(likely, matches(F.col("line_text"), SCHEME_URL)).otherwise(F.expr("array()").cast(MATCHES)))


def bare_domain_matches(lines: DataFrame, wanted: bool = True, tlds: Sequence[str] = TLDS) -> DataFrame:
    """lines with bare: matches of a domain and a path whose top-level domain is one of tlds."""
    none = F.expr("array()").cast(MATCHES)
    if not wanted:
        return lines.withColumn("bare", none)
    found = F.filter(matches(F.col("line_text"), BARE_URL), lambda m: bare_tld(m["value"]).isin(*tlds))
    return lines.withColumn("bare", F.when(F.col("line_text").contains("/"), found).otherwise(none))


def drop_bare_under_scheme(lines: DataFrame) -> DataFrame:
    """lines whose bare matches don't overlap a scheme match; both spans count as matched, untrimmed.

    Scheme matches are in order and apart, so of those that begin before a bare match ends only the last can reach it."""
    lines, end = computed_once(lines, "spans", "scheme", "bare"), lambda m: m["start_off"] + F.length(m["value"])
    before = lambda b: n_up_to(F.size("scheme"), lambda i: F.get("scheme", i)["start_off"], end(b) - 1)
    overlaps = lambda b: F.coalesce(end(F.get("scheme", before(b) - 1)) > b["start_off"], F.lit(False))
    return lines.withColumn("bare", F.filter("bare", lambda b: ~overlaps(b)))


def _touched(start: Column, end: Column) -> Column:
    """The spans that a match from start to end touches: neighbours, since spans are in order and apart.  A search by
    halves is many small steps, so a few spans are looked through."""
    n, at = F.size("spans"), lambda i: F.get("spans", i)
    first = n_up_to(n, lambda i: at(i)["end_off"], start)
    found = F.slice("spans", first + 1, F.greatest(F.lit(0), n_up_to(n, lambda i: at(i)["start_off"], end - 1) - first))
    return F.when(n <= FEW_SPANS, F.filter("spans", lambda s: (s["end_off"] > start) & (s["start_off"] < end))).otherwise(found)


def candidate_uris(lines: DataFrame, uri_filter: Callable[[Column], Column] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per match that the filter accepts: is_bare, match_no, candidate (trimmed), uri, hit (the line's spans that
    the candidate touches), and the line's columns in keep."""
    tagged = lambda name, bare: F.transform(name, lambda m: F.struct(F.lit(bare).alias("is_bare"), m.alias("m")))
    cut = lambda x: F.struct(x["is_bare"].alias("is_bare"), x["m"]["match_no"].alias("match_no"), x["m"]["start_off"].alias("start_off"), trim_trailing_punctuation(x["m"]["value"]).alias("candidate"))
    touched = lambda m: _touched(m["start_off"], m["start_off"] + F.length(m["candidate"])).alias("hit")
    target = lambda m: F.when(m["is_bare"] == 1, F.concat(F.lit("https://"), m["candidate"])).otherwise(m["candidate"])
    some = lines.where((F.size("scheme") > 0) | (F.size("bare") > 0))
    trimmed = F.transform(F.concat(tagged("scheme", 0), tagged("bare", 1)), cut)
    every = F.transform(trimmed, lambda m: F.struct(m["is_bare"].alias("is_bare"), m["match_no"].alias("match_no"), m["candidate"].alias("candidate"), target(m).alias("__target"), touched(m)))
    of_line = (*PAGE, "line_no", "source_rank", *keep)
    each = some.select(*of_line, F.explode(every).alias("m")).select(*of_line, "m.*").where("candidate <> ''")
    return computed_once(each.withColumn("uri", (uri_filter or default_uri_filter)(F.col("__target"))).drop("__target"), "uri").where("uri is not null")


def match_to_rect(candidates: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """candidates with the box around all chunks that the trimmed match touches; one that touches none is dropped."""
    out = candidates.where(F.size("hit") > 0)
    side = lambda name: F.col("hit")["box"][name]
    out = out.withColumns({"left_pt": F.array_min(side("x0")), "bottom_pt": F.array_min(side("y0")), "__right": F.array_max(side("x1")), "__top": F.array_max(side("y1"))})
    out = out.withColumns({"width_pt": F.col("__right") - F.col("left_pt"), "height_pt": F.col("__top") - F.col("bottom_pt")})
    return out.select(*PAGE, "line_no", "is_bare", "match_no", "uri", "left_pt", "bottom_pt", "width_pt", "height_pt", *keep)
