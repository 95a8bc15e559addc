"""Document fingerprints: bottom-k sketches of shingle hashes, on DataFrame functions alone.

A sketch holds the k smallest distinct hashes of a text's shingles, ascending.  Sketches of parts merge into that of
the whole, and two of them estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import n_up_to

#: Hashes in a sketch, words in a shingle, hexadecimal digits of a hash (48 bits).
K, WORDS, DIGITS = 128, 5, 12
_RANGE = 1 << (4 * DIGITS)


def _hash(*x: Column) -> Column:
    return F.xxhash64(*x).bitwiseAND(F.lit(_RANGE - 1))


def with_bottom_k(df: DataFrame, text: Column, name: str, k: int = K, words: int = WORDS) -> DataFrame:
    """df with the sketch of text in column name (array<bigint>).

    Shingles are runs of five words, hashed from the hashes of their words; a text of one to four words is one
    shingle, white space between them counted as one space; null texts and texts without words have an empty sketch.
    """
    # columns of their own, so that none is worked out twice
    df = df.withColumn("__plain", F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")))
    df = df.withColumn("__words", F.transform(F.split("__plain", " "), lambda x: F.xxhash64(x)))
    starts = F.slice("__words", F.lit(1), F.greatest(F.size("__words") - (words - 1), F.lit(0)))
    df = df.withColumn("__hashes", F.transform(starts, lambda x, i: _hash(x, *[F.get("__words", i + j) for j in range(1, words)])))
    sketch = F.slice(F.sort_array(F.array_distinct("__hashes")), 1, k)
    short = F.when(F.col("__plain") == "", F.array().cast("array<bigint>")).otherwise(F.array(_hash(F.col("__plain"))))
    return df.withColumn(name, F.when(F.size("__hashes") > 0, sketch).otherwise(short)).drop("__plain", "__words", "__hashes")


def merge(x: Column, y: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(x, y)), 1, k)


def resemblance(x: Column, y: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the joint sketch that both have; 1 for two empty ones."""
    both = merge(x, y, k)
    share = F.size(F.array_intersect(both, F.array_intersect(x, y))) / F.size(both)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(share)


def distinct_shingles(x: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(x) < k, F.size(x).cast("double")).otherwise((k - 1) * F.lit(float(_RANGE)) / F.element_at(x, k))


def containment(x: Column, y: Column, k: int = K) -> Column:
    """Estimated share of x's shingles that y has; 1 if x has none."""
    n_both = resemblance(x, y, k) * distinct_shingles(merge(x, y, k), k)
    return F.when(F.size(x) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), n_both / distinct_shingles(x, k)))


def as_text(x: Column) -> Column:
    """A sketch as hexadecimal digits, DIGITS for each hash."""
    return F.array_join(F.transform(x, lambda h: F.lpad(F.hex(h), DIGITS, "0")), "")


def with_next(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """df with next_<column> of the row that follows in order (null first; the first row's after the last).

    Rows are dealt to ranges of order by approximate quantiles, so one shuffle carries them; the first row of each
    range is sent to the range before it as well.  Rows of equal order follow each other by the first column's hash.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(F.percentile_approx(order, [i / n for i in range(1, n)], 10_000)).first()[0] or []
    cuts = sorted({c for c in cuts if c is not None})
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    at = F.when(F.col(order).isNull(), 0).otherwise(n_up_to(F.lit(len(cuts)), lambda i: F.get(bounds, i), F.col(order))) if cuts else F.lit(0)
    rows = df.withColumn("__range", at).withColumn("__tie", F.xxhash64(columns[0]))
    # the first row of each range in use: one row a range
    first = rows.groupBy("__range").agg(F.min(F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("key"), F.col("__tie").alias("tie"))).alias("f")).select("__range", "f.*").collect()
    if not first:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    first.sort(key=lambda r: r["__range"])
    before = {r["__range"]: first[i - 1]["__range"] for i, r in enumerate(first)}
    heads = {r["__range"]: r for r in first}
    send = F.create_map(*[F.lit(x) for r in before for x in (r, before[r])])
    key = F.create_map(*[F.lit(x) for r in heads for x in (r, heads[r]["tie"])])
    keys = [(r, heads[r]["key"]) for r in heads]
    order_key = F.create_map(*[F.lit(x) if i % 2 == 0 else F.lit(x).cast("long") for r in keys for i, x in enumerate(r)])
    is_head = F.col(order).eqNullSafe(F.element_at(order_key, F.col("__range"))) & (F.col("__tie") == F.element_at(key, F.col("__range")))
    copies = F.when(is_head, F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("sent")), F.struct(F.element_at(send, F.col("__range")).alias("r"), F.lit(True).alias("sent")))).otherwise(F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("sent"))))
    rows = rows.withColumn("__to", F.explode(copies)).withColumn("__part", F.col("__to.r")).withColumn("__sent", F.col("__to.sent")).drop("__to")
    w = Window.partitionBy("__part").orderBy("__sent", F.col(order).asc_nulls_first(), "__tie")
    out = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.where("not __sent").drop("__range", "__tie", "__part", "__sent")


def fingerprint_edits(df: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles_estimate,
    kept_estimate (share of the text's shingles that the edited text keeps) for each row of df (doc_id, text).

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next row's text.  Null texts are empty.  A single row follows itself; an empty table gives no rows.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = with_bottom_k(docs, F.col("text"), "sketch", k)
    rows = with_next(docs, "doc_id", ["text", "sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_bottom_k(rows, F.col("edited"), "edited_sketch", k)
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles_estimate"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("kept_estimate"),
    )
