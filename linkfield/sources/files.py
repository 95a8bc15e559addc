"""Input files by kind, output names, and the link table as a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The extensions that count as images; everything else is taken as a document.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp")

LINK_COLUMNS = ("doc_id", "page_number", "uri", "left_pt", "bottom_pt", "width_pt", "height_pt")


def read_paths(spark: SparkSession, glob: str) -> DataFrame:
    """path and length of files; their contents are not read."""
    return spark.read.format("binaryFile").load(glob).select("path", "length")


def read_contents(spark: SparkSession, glob: str) -> DataFrame:
    """Files with their bytes, for engines that need them."""
    return spark.read.format("binaryFile").load(glob)


def file_kind(path: Column) -> Column:
    return F.when(F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*IMAGE_EXTENSIONS), "image").otherwise("document")


def classify_inputs(paths: DataFrame) -> DataFrame:
    """paths with kind: image or document, by extension alone."""
    return paths.withColumn("kind", file_kind(F.col("path")))


def output_paths(paths: DataFrame) -> DataFrame:
    """paths with output: beside the input, its name without the last extension, and -linked.pdf."""
    folder, name = F.regexp_extract("path", r"^(.*/)?([^/]*)$", 1), F.regexp_extract("path", r"^(.*/)?([^/]*)$", 2)
    return paths.withColumn("output", F.concat(folder, F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("-linked.pdf")))


def image_page_size(images: DataFrame, dpi: int = 150) -> DataFrame:
    """Images with the size of the page that they become, in points."""
    return images.withColumns({"page_width_pt": F.col("bitmap_width") * 72 / dpi, "page_height_pt": F.col("bitmap_height") * 72 / dpi})


def link_annotations(links: DataFrame) -> DataFrame:
    """Annotation rows to add: new links only, with an invisible border."""
    new = links.where("status = 'linked'")
    return new.select(*LINK_COLUMNS, F.lit("Link").alias("subtype"), F.array(F.lit(0), F.lit(0), F.lit(0)).alias("border"))


def write_by_page(rows: DataFrame, table: str, buckets: int, mode: str = "errorifexists") -> None:
    """rows as a table with buckets by page, pages in order within them.  Tables of one number of buckets are joined and
    grouped by page without a shuffle: chunks, annotations, located links."""
    rows.repartition(buckets, "doc_id", "page_number").write.mode(mode).bucketBy(buckets, "doc_id", "page_number").sortBy("doc_id", "page_number").format("parquet").saveAsTable(table)


def write_links(links: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The link table, partitioned by status."""
    links.write.mode(mode).partitionBy("status").parquet(path)
