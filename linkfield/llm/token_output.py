"""Token ids in binary shards: each document a zstandard frame of its own, one dictionary for all of them.

A shard is one byte string (see Shard) with the dictionary's hash, an index and the frames; a document is read by
its index entry without touching the others.  Spark writes shards as the rows of a Parquet table in the order of
document ids, so its committer sees to retries and lost executors.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import new_path, small, written
from .tokens import SLICE_CHARS, encoder, text_slices, tokenizer_path

MAGIC = b"TOKSHRD1"
HEAD = struct.Struct("<8sIIQ32s")  # magic, bytes an id, zero, documents, sha256 of the dictionary
#: Compressed bytes after which a shard ends; a longer document has a shard of its own.
SHARD_BYTES = 1 << 20
#: The dictionary is trained on so many documents at most, those first in the order of their ids' hashes among texts
#: of up to SAMPLE_CHARS characters.  It changes sizes only, never what is read back.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 1000, 1 << 16, 1 << 16


def serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(id_arrays: Iterable[np.ndarray], width: int, size: int = DICT_BYTES) -> bytes:
    """Empty if there is too little to train on."""
    samples = [serialized(x, width) for x in id_arrays]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


@dataclass
class Shard:
    """doc_ids (None allowed), token counts and frames of some documents, as bytes and back.

    After HEAD: validity (u1 each), doc_ids (i8), token counts (u8), frame ends (u8), then the frames.
    """

    doc_ids: Sequence[int | None]
    counts: Sequence[int]
    frames: Sequence[bytes]
    width: int

    def to_bytes(self, dictionary: bytes) -> bytes:
        valid = np.array([x is not None for x in self.doc_ids], "u1")
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        ends = np.cumsum([len(x) for x in self.frames], dtype="<u8")
        head = HEAD.pack(MAGIC, self.width, 0, len(ids), hashlib.sha256(dictionary).digest())
        return b"".join([head, valid.tobytes(), ids.tobytes(), np.array(self.counts, "<u8").tobytes(), ends.tobytes(), *self.frames])


class ShardReader:
    """Random access to the documents of a shard; the dictionary must be the one it was written with."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, self.width, _, n, digest = HEAD.unpack_from(data)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard, or one of another dictionary")
        at = HEAD.size
        valid, ids, self.counts, ends = (np.frombuffer(data, t, n, at + n * skip) for t, skip in (("u1", 0), ("<i8", 1), ("<u8", 9), ("<u8", 17)))
        self.doc_ids = [int(x) if ok else None for x, ok in zip(ids, valid, strict=True)]
        self.ends = np.concatenate([[0], ends]).astype(np.int64) + at + 25 * n
        self.data, self.decompressor = data, zstandard.ZstdDecompressor(dict_data=_dict(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        raw = self.decompressor.decompress(self.data[self.ends[k] : self.ends[k + 1]], max_output_size=int(self.counts[k]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def _sample(df: DataFrame, path: str, end_id: int, width: int) -> bytes:
    """The dictionary of a bounded sample, trained in one task; only the dictionary comes to the driver."""
    first = df.where(f"length(text) <= {SAMPLE_CHARS}").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    rows = df.join(F.broadcast(first.distinct()), "doc_id").where(f"length(text) <= {SAMPLE_CHARS}").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(SAMPLE_DOCS)

    def trained(batches):
        found = sorted((h, t or "") for batch in batches for h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([train_dictionary((np.append(x, np.uint32(end_id)) for x in encoder(path).encode([t for _, t in found])), width)], pa.binary())], names=["dictionary"])

    one = rows.select(F.xxhash64("doc_id", "text").alias("h"), "text").repartition(1).mapInArrow(trained, "dictionary binary").first()
    return bytes(one["dictionary"]) if one else b""


def write_token_shards(df: DataFrame, out: str, end_id: int = 1, tokenizer: str | None = None, level: int = 3) -> bytes:
    """Writes df's documents (doc_id, text) to the shard table out, in ascending doc_id order (null first); returns
    the dictionary, also written to out/dictionary.  Null text is empty: its end id alone.  Documents of equal id
    follow each other by the checksum of their ids, then their number.  Columns: part and shard give the order, first_doc and last_doc a range.
    """
    spark, path = df.sparkSession, tokenizer_path(tokenizer)
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = 2 if max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = _sample(df, path, end_id, width)

    def compress(batches):
        enc, how = encoder(path), _dict(dictionary)
        if how:
            how.precompute_compress(level=level)
        zstd = zstandard.ZstdCompressor(level=level, dict_data=how)
        for ids, texts in text_slices(batches, "doc_id", "text"):
            tokens = [np.append(x, np.uint32(end_id)) for x in enc.encode(texts)]
            columns = [pa.array(ids, pa.int64()), pa.array([len(x) for x in tokens], pa.int64()), pa.array([zstd.compress(serialized(x, width)) for x in tokens], pa.binary()), pa.array([zlib.crc32(x) for x in tokens], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "frame", "crc"])

    def shards(batches):
        part, number, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            data = Shard([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], width).to_bytes(dictionary)
            known = [r[0] for r in rows if r[0] is not None]
            one = (part, number, known[0] if known else None, known[-1] if known else None, sum(r[1] for r in rows), data)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "shard", "first_doc", "last_doc", "n_tokens", "data"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and size + len(row[2]) > SHARD_BYTES:
                    yield packed()
                    rows, size, number = [], 0, number + 1
                rows.append(row)
                size += len(row[2])
        if rows:
            yield packed()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written first: finding the ranges reads it, and must not encode everything once more
    frames = written(df.mapInArrow(compress, "doc_id long, n long, frame binary, crc long"), "frames")
    # the last key splits rows that are alike in all others, whose order doesn't matter
    order = [F.col("doc_id").asc_nulls_first(), F.col("crc"), F.col("n")]
    ordered = frames.repartitionByRange(n, *order, F.rand(7)).sortWithinPartitions(*order)
    table = ordered.drop("crc").mapInArrow(shards, "part int, shard int, first_doc long, last_doc long, n_tokens long, data binary")
    table.write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(f"{out}/shards")
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").write.parquet(f"{out}/dictionary")
    return dictionary


def read_token_shards(spark: SparkSession, out: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """part, shard, k (place in the shard), doc_id, start_in_shard, ids; only those documents where doc_ids are given
    (shards are then chosen by their ranges and single frames read by the index)."""
    first = spark.read.parquet(f"{out}/dictionary").first()
    dictionary = bytes(first["dictionary"])
    table = spark.read.parquet(f"{out}/shards")
    wanted = None if doc_ids is None else frozenset(doc_ids)
    if wanted is not None:
        table = table.where(F.exists(F.array(*[F.lit(x).cast("long") for x in sorted(wanted)]), lambda x: x.between(F.col("first_doc"), F.col("last_doc"))))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader, start, out, size = ShardReader(row["data"], dictionary), 0, [], 0
                for k, doc in enumerate(reader.doc_ids):
                    if wanted is None or doc in wanted:
                        out.append((row["part"], row["shard"], k, doc, start, reader.ids(k)))
                        size += int(reader.counts[k])
                    start += int(reader.counts[k])
                    if out and (size > SLICE_CHARS or k + 1 == len(reader)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["part", "shard", "k", "doc_id", "start_in_shard", "ids"])
                        out, size = [], 0

    return table.select("part", "shard", "data").mapInArrow(read, "part int, shard int, k int, doc_id long, start_in_shard long, ids array<long>")


def shard_starts(spark: SparkSession, out: str) -> DataFrame:
    """part, shard, shard_start: ids of all shards before; sums run within parts, then over one row a part."""
    shards = spark.read.parquet(f"{out}/shards").select("part", "shard", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    within = shards.withColumn("at", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens"))
    return within.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("at")).alias("shard_start"))


def token_digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_token_shards reads: checks every id without moving them on."""
    dictionary = bytes(spark.read.parquet(f"{out}/dictionary").first()["dictionary"])

    def digest(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader = ShardReader(row["data"], dictionary)
                arrays = [reader.ids(k) for k in range(len(reader))]
                counts = np.array([len(x) for x in arrays], np.int64)
                n = len(arrays)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(reader.doc_ids, pa.int64()), pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in arrays], pa.int64())], names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(f"{out}/shards").select("part", "shard", "data").mapInArrow(digest, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(small(shard_starts(spark, out), 32), ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read_back(df: DataFrame, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Writes df's documents as shards in the shared folder and returns their digests as read from there."""
    out = new_path(df.sparkSession, "tokens")
    write_token_shards(df, out, end_id, tokenizer)
    return token_digests(df.sparkSession, out)
