"""Scans of what has changed.

Chunks arrive in batches, one folder each: whole pages, new or edited.  A ledger has the content hash of every page that
was scanned and the batch it came with; links are kept beside it.  A run reads batches after the ledger's last one, scans
the pages whose hash is new, and replaces the parts of both tables that these pages are in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.existing import existing_links, split_existing
from ..operators.lines import PAGE
from ..options import DEFAULT, ScanOptions
from ..sources.shared import written
from .jobs import located_text

LEDGER = "doc_id long, page_number int, content string, batch long, part int"


def content_hashes(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One hash per page (and value of by, which isn't part of it), whatever the order of its rows."""
    columns = sorted(c for c in chunks.columns if c not in by)
    row = F.xxhash64(*[c for c in columns if c not in PAGE]).cast("decimal(20,0)")
    return chunks.groupBy(*PAGE, *by).agg(F.concat_ws("-", F.count("*").cast("string"), F.sum(row).cast("string"), F.hex(F.bit_xor(F.xxhash64(*columns)))).alias("content"))


def part_of(parts: int):
    return F.pmod(F.xxhash64(*PAGE), F.lit(parts)).cast("int")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one before the first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _replace(rows: DataFrame, path: str) -> None:
    """Puts rows in the place of the parts that they are in; other parts stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def scan_changes(spark: SparkSession, batches: str, state: str, options: ScanOptions = DEFAULT, parts: int = 64) -> DataFrame:
    """Brings the links at state up to date with the chunks in batches/batch=<n>, and returns all of them, located.

    A page that comes again replaces what it was, within a run the latest batch wins; one whose only chunk has null text
    is removed.  Only new batches are read, and of these only hashes, and chunks of pages that may have a URL, are shuffled.
    Links are replaced first, then the ledger; a run that was cut off between the two scans the same pages again and puts
    the same rows in their place.  So does a batch that is delivered twice: its hashes are known.  Rows of a part are
    written whole, so a part with nothing left keeps its ledger rows alone."""
    ledger = _table(spark, f"{state}/ledger", LEDGER)
    last = ledger.agg(F.max("batch")).first()[0]
    incoming = spark.read.parquet(batches).where(F.col("batch") > F.lit(-1 if last is None else last))
    each = content_hashes(incoming.dropna(subset=list(PAGE)), ("batch",))
    hashed = each.groupBy(*PAGE).agg(F.max_by("content", "batch").alias("content"), F.max("batch").alias("batch")).withColumn("part", part_of(parts))
    known = ledger.select(*PAGE, F.col("content").alias("had"))
    seen = written(hashed.join(known, list(PAGE), "left"), "seen")
    if seen.isEmpty():
        return _links(spark, state)
    changed = seen.where(~F.col("content").eqNullSafe(F.col("had"))).select(*PAGE, "batch")
    # keys are unique in changed: an inner join, since Spark moves the scan's test for marks below that, not below a semi-join
    links = written(located_text(incoming.join(changed, changed.columns).drop("batch"), options).withColumn("part", part_of(parts)), "changed")
    touched = seen.select("part").distinct()
    old = _table(spark, f"{state}/links", links.schema.simpleString()[7:-1].replace(":", " "))
    kept = old.join(F.broadcast(touched), "part", "left_semi").join(changed, list(PAGE), "left_anti").unionByName(links)
    # a part that loses its last link has a row without a page, or the overwrite would leave it as it was
    emptied = touched.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in links.schema.fields if f.name != "part"], "part")
    _replace(written(kept.unionByName(emptied).where("doc_id is not null").unionByName(emptied), "links"), f"{state}/links")
    rows = ledger.join(F.broadcast(touched), "part", "left_semi").join(seen.select(*PAGE), list(PAGE), "left_anti")
    _replace(written(rows.unionByName(seen.select(*[f.split()[0] for f in LEDGER.split(", ")])), "ledger"), f"{state}/ledger")
    return _links(spark, state)


def _links(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(f"{state}/links").where("doc_id is not null").drop("part")


def relink_changes(spark: SparkSession, batches: str, state: str, annotations: DataFrame, options: ScanOptions = DEFAULT, parts: int = 64) -> DataFrame:
    """scan_changes, judged against annotations: where links are doesn't depend on these."""
    return split_existing(scan_changes(spark, batches, state, options, parts), existing_links(annotations))
