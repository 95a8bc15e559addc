"""Vectors as short codes: one byte for each part, the nearest entry of the part's codebook.

Codebooks are trained by rounds of assignment in whole numbers.  After the first, exact one a part's state is kept
between rounds: its b closest entries in order of lower bounds of their distances, and one outer bound for all others.
Entries move, bounds give way by as much; only what they leave open is measured again, in integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import shared_dir, small, written
from .quantised import matrix, of_one_length, quantised

STATE = "vec_id long, label long, q array<int>, near binary, low binary, walked binary, error long"

#: In walked: the part was measured against every entry (first round, or the outer bound was too low).
FIRST, ALL = 0, 255

#: Share of parts that the outer bound may fail before lists become longer, and that of others that lists must suffice for.
FAILED, SUFFICES = 1 / 16, 0.99


def _down(squares: np.ndarray) -> np.ndarray:
    """Square roots, a little less."""
    return np.sqrt(squares.astype(float)) * (1 - 1e-12)


def _halves(low: np.ndarray) -> np.ndarray:
    """Bounds as 16-bit floats that aren't above them, and not below zero."""
    low = np.clip(low, 0, None)
    out = np.minimum(low, 65504).astype(np.float16)
    return np.where(np.isinf(low), np.float16(np.inf), np.where(out > low, np.nextafter(out, np.float16(-np.inf)), out)).astype(np.float16)


def nearest_lists(q: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For parts q (n x width) and their codebook: the b nearest entries in order (ties to lower index), bounds of their
    distances and one for all others, least squared distances."""
    n = len(book)
    squares = (q * q).sum(1)[:, None] - 2 * (q @ book.T) + (book * book).sum(1)[None, :]
    keys = squares * n + np.arange(n)
    keys = np.sort(keys if b >= n else np.partition(keys, b, axis=1)[:, : b + 1], axis=1)
    low = _down(keys // n)
    outer = low[:, b : b + 1] if b < n else np.full((len(q), 1), np.inf)
    return (keys[:, :b] % n).astype(np.uint8), np.concatenate([low[:, :b], outer], axis=1), keys[:, 0] // n


def _fitted(near: np.ndarray, low: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of b entries: the rest goes under the outer bound, or the first entry is repeated."""
    had = near.shape[1]
    if b <= had:
        return near[:, :b], low[:, : b + 1]
    return np.concatenate([near, np.repeat(near[:, :1], b - had, axis=1)], axis=1), np.concatenate([low, np.repeat(low[:, -1:], b - had, axis=1)], axis=1)


def advanced(q: np.ndarray, part: np.ndarray, near: np.ndarray, low: np.ndarray, book: np.ndarray, moved: np.ndarray, b: int):
    """State of parts after entries have moved: lists of b entries, bounds, how far each list was walked, squared
    distance to the nearest entry.  q is n x width, part tells each row's codebook, moved how far entries went at most."""
    had, n = near.shape[1], book.shape[1]
    low = low - np.concatenate([moved[part[:, None], near], moved.max(axis=1)[part][:, None]], axis=1)
    low = np.minimum.accumulate(np.clip(low, 0, None)[:, ::-1], axis=1)[:, ::-1].copy()  # in order, as the list is walked from its front
    near = near.copy()
    error = ((q - book[part, near[:, 0]]) ** 2).sum(1)
    upper = np.sqrt(error.astype(float)) * (1 + 1e-12)
    walked = np.maximum((low[:, :had] <= upper[:, None]).sum(1), 1)
    everything = low[:, had] <= upper
    for m in np.unique(walked[~everything]).tolist():
        rows = np.flatnonzero((walked == m) & ~everything)
        entries = near[rows, :m].astype(np.int64)
        keys = np.sort(((q[rows][:, None, :] - book[part[rows][:, None], entries]) ** 2).sum(-1) * n + entries, axis=1)
        near[rows, :m], low[rows, :m], error[rows] = keys % n, _down(keys // n), keys[:, 0] // n
    low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
    near, low = _fitted(near, low, b)
    near, low = near.copy(), low.copy()
    for p in np.unique(part[everything]).tolist():
        rows = np.flatnonzero(everything & (part == p))
        near[rows], low[rows], error[rows] = nearest_lists(q[rows], book[p], b)
    return near, low, np.where(everything, ALL, np.minimum(walked, ALL - 1)).astype(np.uint8), error


def _rows(batch, near, low, walked, error) -> pa.RecordBatch:
    n = batch.num_rows
    raw = lambda x: pa.array([r.tobytes() for r in np.ascontiguousarray(x).reshape(n, -1)], pa.binary())
    columns = [batch.column(c) for c in ("vec_id", "label", "q")] + [raw(near), raw(_halves(low)), raw(walked), pa.array(error.reshape(n, -1).sum(1))]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "q", "near", "low", "walked", "error"])


def _first(book: np.ndarray, b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = matrix(batch.column("q")).reshape(batch.num_rows, len(book), -1)
                near, low, error = (np.stack(x, axis=1) for x in zip(*(nearest_lists(q[:, p], book[p], b) for p in range(len(book))), strict=True))
                yield _rows(batch, near, low, np.full(near.shape[:2], FIRST, np.uint8), error)

    return run


def _again(book: np.ndarray, moved: np.ndarray, had: int, b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                q = matrix(batch.column("q")).reshape(n * len(book), -1)
                near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.uint8).reshape(-1, had)
                low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.float16).reshape(-1, had + 1).astype(float)
                yield _rows(batch, *advanced(q, np.tile(np.arange(len(book)), n), near, low, book, moved, b))

    return run


def _tallied(parts: int, entries: int, width: int):
    """Per task, in numbered slots: parts by codebook entry, sums of their components, parts by length of walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, walks = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64), np.zeros(ALL + 1, np.int64)
        for batch in batches:
            if n := batch.num_rows:
                near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.uint8).reshape(n * parts, -1)[:, 0]
                slot = np.tile(np.arange(parts) * entries, n) + near
                np.add.at(count, slot, 1)
                np.add.at(total, slot, matrix(batch.column("q")).reshape(n * parts, width))
                walks += np.bincount(np.frombuffer(b"".join(batch.column("walked").to_pylist()), np.uint8), minlength=ALL + 1)
        slots = np.concatenate([count, total.ravel(), walks])
        some = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(slots[some])], names=["slot", "total"])

    return run


def length_of_lists(walks: np.ndarray, b: int, entries: int) -> int:
    """The next length: twice as long where the outer bound failed often, else what nearly all lists were walked for and
    one entry more; an eighth of the entries at least."""
    listed = walks[1:ALL]
    if walks[ALL] > FAILED * max(1, walks[1:].sum()):
        return min(entries, 2 * b)
    if not listed.sum():
        return b
    enough = int(np.searchsorted(np.cumsum(listed), SUFFICES * listed.sum())) + 1
    return max(1, min(entries, max(enough + 1, entries // 8)))


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """One row per vector of df: vec_id, code (two hex digits a part), error (squared distances, summed over parts),
    label_error (errors summed over equal labels, null ones together), codebooks_sha256 (of all components).

    Components become floor(256 * x), held to +-2^22 (those of x beyond +-16,384 alone).  A codebook starts as its part
    of the vectors with the smallest ids (null last, ties by components); with fewer vectors than `entries` (256 at
    most) it has fewer.  Each round assigns every part to the nearest entry, ties to the lower one, and replaces entries
    by their parts' floored means; entries without parts stay.  A last assignment follows.  Vectors that are null or
    hold null or non-finite components have no row; shorter ones, empty ones too, are followed by zeros up to the
    longest, rounded up to a multiple of `parts`.  Repeated rows and ids count as often as they come.  An empty table
    gives no rows.

    Tasks add up counts and sums by entry, so what meets is as large as the codebooks; these travel to tasks as they
    are.  State between rounds is a table.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    spark = df.sparkSession
    shared_dir(spark)
    rows, length = of_one_length(written(quantised(df, id_col, vec_col, label_col), "integers"), parts)
    seeds = [r.q for r in rows.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect()]
    if not seeds:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    n, width = len(seeds), length // parts
    book = np.array(seeds, np.int64).reshape(n, parts, width).transpose(1, 0, 2).copy()
    b = max(1, n // 4)
    state = written(rows.mapInArrow(_first(book, b), STATE), "codes")
    for _ in range(rounds):
        slots = np.zeros(parts * n * (1 + width) + ALL + 1, np.int64)
        for r in state.select("q", "near", "walked").mapInArrow(_tallied(parts, n, width), "slot int, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect():
            slots[r.slot] = r.total
        count, total, walks = np.split(slots, [parts * n, parts * n * (1 + width)])
        count, total = count.reshape(parts, n, 1), total.reshape(parts, n, width)
        new = np.where(count > 0, total // np.maximum(count, 1), book)
        moved = np.sqrt(((new - book) ** 2).sum(-1).astype(float)) * (1 + 1e-12)
        had, b, book = b, length_of_lists(walks, b, n), new
        state = written(state.mapInArrow(_again(book, moved, had, b), STATE), "codes")
    coded = state.select("vec_id", "label", _code("near", parts, b).alias("code"), "error")
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    out = coded.join(small(errors, 16), F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _code(near: str, parts: int, b: int):
    """The first entry of every list in lower-case hex."""
    digits = F.lower(F.hex(near))
    return F.concat(*[F.substring(digits, 2 * b * p + 1, 2) for p in range(parts)])
