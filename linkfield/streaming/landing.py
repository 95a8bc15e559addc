"""New chunks from a landing folder, linked batch by batch.

Pages are independent, so a batch is a whole job of its own.  Adding links that are there already adds nothing, which
makes a replayed batch harmless as long as it sees the annotations that earlier batches wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..options import DEFAULT, ScanOptions
from ..plans.jobs import scan_text
from ..sources.files import link_annotations


def link_landing_folder(spark: SparkSession, chunks_path: str, schema: str, annotations: Callable[[], DataFrame], out: str, checkpoint: str, options: ScanOptions = DEFAULT, **trigger) -> StreamingQuery:
    """Annotation rows of every batch of chunk files, one folder per batch (a replay overwrites its own).

    A page's chunks must arrive in one batch.  annotations gives the links to respect, read anew for each batch.
    """
    chunks = spark.readStream.schema(schema).parquet(chunks_path)

    def batch(rows: DataFrame, number: int) -> None:
        link_annotations(scan_text(rows, annotations(), options)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
