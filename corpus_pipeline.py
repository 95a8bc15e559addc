"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkfield.llm.common import new_path, small, table, written
from linkfield.llm.line_dedup import drop_boilerplate_lines
from linkfield.llm.mixing import mixed_documents
from linkfield.llm.ngram_join import jaccard_classes
from linkfield.llm.packing import pack_documents
from linkfield.llm.toxicity import drop_toxic, held_out, train


#: Rows of whole texts that go to a Python worker at once, on both sides of the pipe; Spark's own 10,000 are tens of MB.
ARROW_ROWS = 1000


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _short_batches(spark: SparkSession) -> None:
    """For what a stage returns, which runs when the caller writes it; run() puts the setting back."""
    spark.conf.set(_BATCH, ARROW_ROWS)


def _in_order(docs: DataFrame) -> Column:
    """A row's place among rows of one id and text: by its columns, those that have no order by their JSON."""
    ordered = lambda t: not any(x in t for x in ("map<", "variant", "interval"))
    return F.struct(*[F.col(f"`{c}`") if ordered(t) else F.to_json(F.struct(F.col(f"`{c}`"))) for c, t in docs.dtypes])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the fit sees the labels that aren't held out."""
    _short_batches(spark)
    weights = train(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return drop_toxic(docs, weights)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text."""
    cleaned = drop_boilerplate_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts links connect one: that with the smallest id (null last), then hash of the text, then other
    columns.  Rows are told by id and text, so unlike texts under one id stay; texts without words stay, too."""
    _short_batches(spark)
    rows = written(jaccard_classes(docs).select("doc_id", "text_hash", "class").where("class is not null"), "classes")
    key = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    groups = rows.groupBy("class").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").select("class", "first")
    of_groups = rows.join(groups, "class").groupBy(F.col("doc_id").alias("__class_id"), F.col("text_hash").alias("__class_text"), (key == F.col("first")).alias("stays")).count()
    of_groups = written(of_groups, "others")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__class_id")) & (F.xxhash64(docs["text"]) == F.col("__class_text"))
    kept = docs.join(small(of_groups.where("not stays").select("__class_id", "__class_text"), 32), same, "left_anti")
    repeated = of_groups.where("stays and count > 1").select("__class_id", "__class_text")
    if repeated.isEmpty():
        return kept
    repeated = small(repeated, 32)
    one = kept.join(repeated, same, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(F.struct(*docs.columns), _in_order(docs)).alias("row")).select("row.*")
    return kept.join(repeated, same, "left_anti").unionByName(one)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    _short_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("ngram_join", one_of_each_group),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: Hashing, classification and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents; every stage is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(_BATCH)
    try:
        for name, stage in STAGES:
            path = new_path(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return docs
