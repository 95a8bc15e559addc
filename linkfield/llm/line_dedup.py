"""Line dedup by site-relative frequency, on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_BYTES, shared_dir, written

#: A line in more than this share of its site's pages is boilerplate, if it is in MIN_PAGES pages at least.
MAX_RATIO, MIN_PAGES = 0.01, 3


def boilerplate_lines(df: DataFrame, host_col: str, text_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """host, lines: the hashes (xxhash64) of each site's boilerplate lines.

    A page is a distinct text of a site: exact copies count once, in the line's pages and in the site's total, so
    that a page's own copies don't turn it into boilerplate.  A site has fewer than (mean lines a page) / max_ratio
    such lines, whatever its size, since the ratios of its lines sum up to the mean number of lines a page.
    """
    text = F.col(f"`{text_col}`")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    hashes = F.array_distinct(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x)))
    pages = df.select(F.col(f"`{host_col}`").alias("host"), F.xxhash64(text).alias("page"), hashes.alias("lines"))
    total = pages.where("lines is not null").select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    seen = pages.select("host", "page", F.explode("lines").alias("line")).distinct()
    # the line is in the key, so a hot site spreads over tasks
    counted = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    over = counted.alias("c").join(total.alias("t"), F.expr("c.host <=> t.host")).where(F.col("n") > F.col("total") * F.lit(max_ratio))
    return over.groupBy("c.host").agg(F.sort_array(F.collect_set("line")).alias("lines")).select("host", "lines")


def drop_boilerplate_lines(df: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """df with its text lacking boilerplate lines, and n_lines, n_dropped (replaced if df has such columns).

    Lines are split at \\n and compared without spaces at their ends; blank lines stay.  Null text stays null with
    0 lines; an empty text has one blank line.  Null hosts are one site.  Repeated rows are kept, each judged alike.
    """
    shared_dir(df.sparkSession)
    flagged = written(boilerplate_lines(df, host_col, text_col, max_ratio, min_pages), "boilerplate")
    size = flagged.agg(F.sum(F.size("lines") * 8 + 64)).first()[0] or 0
    flagged = flagged.select(F.col("host").alias("__host"), F.col("lines").alias("__flagged"))
    if size <= BROADCAST_BYTES:
        flagged = F.broadcast(flagged)
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    out = df.select(*[F.col(f"`{c}`") for c in names]).join(flagged, F.col(f"`{host_col}`").eqNullSafe(F.col("__host")), "left")
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__flagged"), F.xxhash64(F.trim(x))))
    kept = F.when(F.col("__flagged").isNull(), lines).otherwise(kept)
    n = F.coalesce(F.size(lines), F.lit(0))
    n = F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(n)
    out = out.withColumn("__kept", kept)
    n_kept = F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.size("__kept"))
    return out.withColumns({"n_lines": n.cast("long"), "n_dropped": (n - n_kept).cast("long"), text_col: F.array_join("__kept", "\n")}).drop("__host", "__flagged", "__kept")
