"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import n_words, small, written

#: Hex digits of the seeded order that split a source into parts for running sums (4096 parts).
PART_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Per source: source_size, weight, target (double).

    sizes has source and size.  Sources by code point, null last, take the weights in turn.  Targets share the sum
    of all sizes by weight; a target above max_epochs times its source is clamped there and the excess is shared
    again by weight until none is above.  With sources in ascending order of cap / weight, the clamped ones are a
    prefix: the first source that isn't clamped gives the water level.  One row per source goes through the window.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(x) for x in weights])
    per = per.withColumn("weight", F.get(w, (F.row_number().over(order) - 1) % len(weights)).cast("long"))
    cap = F.col("source_size") * F.lit(max_epochs)
    per = per.withColumn("cap", cap).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    per = per.withColumn("level", rest.cast("double") / F.sum("weight").over(after))
    per = per.withColumn("level", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    per = per.withColumn("open", F.col("level").isNotNull()).withColumn("level", F.first("level", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(f":{seed}")))


def _placed(df: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """mix_sources with each row's place in the order (h), whole repetitions and whether it gets one more."""
    sizes = written(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), _order(id_col, seed).alias("h")), "mix-sizes")
    targets = source_targets(sizes, weights, max_epochs)
    sizes = sizes.withColumn("part", F.left("h", F.lit(PART_DIGITS)))
    ahead = sizes.groupBy("source", "part").agg(F.sum("size").alias("n")).withColumn("ahead", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).drop("n")
    plan = ahead.alias("a").join(targets.alias("t"), F.expr("a.source <=> t.source")).select("a.source", "a.part", "ahead", "source_size", "target")
    within = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("upto", F.sum("size").over(within))
    out = placed.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source and d.part = p.part"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    before = F.col("ahead") + F.col("upto") - F.col("size")
    room = F.lit(2) * (F.col("target") - whole * F.col("source_size"))
    extra = (F.lit(2) * before + F.col("size")).cast("double") <= room
    out = out.withColumns({"whole": whole, "extra": extra})
    return out.select("d.doc_id", "d.source", "size", "h", "source_size", "target", "whole", "extra")


def mix_sources(df: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of df: doc_id, source, size, source_size, target, taken.

    Every document is repeated floor(target / source_size) times as a whole.  What is missing to the target comes
    from one more repetition of some documents: in the seeded order of their ids, as many as come nearest to it, so
    a source misses its target by half a document at most and no document is taken more than max_epochs times.  The
    order is md5 of id and seed: the same in each run.  Its running sums are taken within 4096 parts of a source,
    the parts' own sums ahead of them, so that a source of any size spreads over tasks.

    Null text has size 0; null sources are one source, last in order; null ids count as an empty id.  Documents with
    equal ids are ordered by size.  An empty table gives no rows.  Other columns of df are left aside.
    """
    repeats = F.col("whole") + F.col("extra").cast("long")
    placed = _placed(df, weights, max_epochs, seed, id_col, text_col, source_col)
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"))


def mixed_documents(df: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df's rows as often as mix_sources repeats them; rows that it takes zero times go.

    One more repetition goes to the rows before some place in their source's order, so a source's whole repetitions
    and that last place decide: one small row per source meets the texts, which are not shuffled.
    """
    placed = _placed(df, weights, max_epochs, seed, id_col, text_col, source_col)
    last = F.max(F.when(F.col("extra"), F.struct("h", F.col("doc_id"), F.col("size"))))
    per_source = written(placed.groupBy("source").agg(F.first("whole").alias("__whole"), last.alias("__last")).withColumnRenamed("source", "__source"), "mix")
    rows = df.withColumns({"__h": _order(id_col, seed), "__n": n_words(F.col(f"`{text_col}`"))})
    rows = rows.join(small(per_source, 256), F.col(f"`{source_col}`").eqNullSafe(F.col("__source")))
    place = F.struct(F.col("__h"), F.col(f"`{id_col}`"), F.col("__n"))
    repeats = F.col("__whole") + F.coalesce(place <= F.col("__last"), F.lit(False)).cast("long")
    rows = rows.withColumn("__repeats", repeats.cast("int")).where("__repeats > 0")
    return rows.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__repeats")))).select(*[F.col(f"`{c}`") for c in df.columns])
