"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from .hashing import ASCII_SPACE, combined, mix, word_hashes
from .tokens import text_slices

#: Rows of each class that the fit takes at most: those first in the order of their ids' hashes.
MAX_ROWS_PER_CLASS = 4000
THRESHOLD = 0.7

SEPARATORS = ASCII_SPACE.copy()
SEPARATORS[list(string.punctuation.encode())] = True


@dataclass(frozen=True)
class Settings:
    bits: int = 20  # of a feature's number; number 0 is the bias
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    epochs: int = 8
    stems: tuple[int, ...] = (4, 6)  # bytes of a word's beginning that count as words of their own


def features(texts: Sequence[str], how: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature number) of every occurrence: words, their beginnings, pairs of neighbours, pairs that
    leave out one or two words.  Words are cut at ASCII white space and punctuation; A-Z count as a-z."""
    firsts, words, stems = word_hashes(texts, SEPARATORS, how.stems)
    owner = np.repeat(np.arange(len(texts)), np.diff(firsts))
    found = [(owner, mix(words + np.uint64(1)))] + [(owner, mix(x + np.uint64(2 + k))) for k, x in enumerate(stems)]
    for kind, gap in ((5, 1), (6, 2), (7, 3)):
        pair = combined(words, (0, gap), kind)
        same = owner[: len(pair)] == owner[gap:] if len(pair) else np.zeros(0, bool)
        found.append((owner[: len(pair)][same], pair[same]))
    number = np.concatenate([x for _, x in found]) >> np.uint64(64 - how.bits)
    return np.concatenate([x for x, _ in found]), number.astype(np.int64)


def feature_sets(texts: Sequence[str], how: Settings) -> list[np.ndarray]:
    owner, number = features(texts, how)
    keys = np.unique((owner << how.bits) | number)
    cuts = np.searchsorted(keys, np.arange(1, len(texts)) << how.bits)
    return [np.union1d(x & ((1 << how.bits) - 1), [0]) for x in np.split(keys, cuts)]


def fit_ftrl(sets: Sequence[np.ndarray], labels: Sequence[int], how: Settings) -> np.ndarray:
    """Weights of all feature numbers: per-coordinate rates from summed squared gradients, exact zeros from L1."""
    z, n = np.zeros(1 << how.bits), np.zeros(1 << how.bits)

    def weights(zs, ns):
        w = (np.sign(zs) * how.l1 - zs) / ((how.beta + np.sqrt(ns)) / how.alpha + how.l2)
        return np.where(np.abs(zs) <= how.l1, 0.0, w)

    for _ in range(how.epochs):
        for x, y in zip(sets, labels, strict=True):
            zs, ns = z[x], n[x]
            w = weights(zs, ns)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / how.alpha
            z[x] = zs + g - sigma * w
            n[x] = ns + g * g
    return weights(z, n)


def train(documents: DataFrame, labels: DataFrame, how: Settings = Settings(), max_rows: int = MAX_ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[int, float]]:
    """(feature number, weight) of the features with weight.

    labels: id_col and label_col (0 or 1; other values and null ids are ignored, an id labelled both ways counts as
    1).  At most max_rows ids of each class are fitted, in one task, each by its text of least hash; what comes back is bounded by the feature space.
    Without labels of both classes the only feature is the bias, towards the class there is (0 if none).
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    order = [F.xxhash64("__id"), F.col("__id")]
    chosen = known.where("__label = 0").orderBy(*order).limit(max_rows).unionByName(known.where("__label = 1").orderBy(*order).limit(max_rows))
    rows = documents.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).join(F.broadcast(chosen), "__id")
    one = F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("text"))).alias("one")  # however many rows an id has
    rows = rows.groupBy("__id", "__label").agg(one).select("__id", "__label", F.col("one.text").alias("__text"))
    rows = rows.select(F.struct(F.xxhash64("__id", F.lit(1)).alias("o"), F.xxhash64("__id").alias("h"), F.col("__label").alias("y")).alias("__meta"), "__text")

    def extract(batches):
        for meta, texts in text_slices(batches, "__meta", "__text"):
            sets = [x.astype(np.int32).tobytes() for x in feature_sets(texts, how)]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in meta], t) for k, t in (("o", pa.int64()), ("h", pa.int64()), ("y", pa.int32()))] + [pa.array(sets, pa.binary())], names=["o", "h", "y", "features"])

    def fit(batches):
        found = []
        for batch in batches:
            found += zip(*(batch.column(c).to_pylist() for c in ("o", "h", "y", "features")), strict=True)
        found.sort(key=lambda r: (r[0], r[1], r[2], len(r[3]), r[3]))
        classes = {r[2] for r in found}
        if len(classes) == 2:
            w = fit_ftrl([np.frombuffer(r[3], np.int32) for r in found], [r[2] for r in found], how)
        else:
            w = np.array([4.0 if classes == {1} else -4.0])
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(w[kept], pa.float64())], names=["feature", "weight"])

    # texts become features where they are; what meets in one task is bounded by max_rows
    found = rows.mapInArrow(extract, "o long, h long, y int, features binary").repartition(1).mapInArrow(fit, "feature int, weight double").collect()
    return [(r.feature, r.weight) for r in found] or [(0, -4.0)]  # no row may mean no task


def held_out(id_col: str) -> Column:
    """Rows that are kept from training: crc32 of the id as text leaves 1 when divided by 3; null ids are not."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _totals(texts: Sequence[str], w: np.ndarray, how: Settings) -> np.ndarray:
    """Each text's sum of weights: the bias, and every feature that it has, once."""
    owner, number = features(texts, how)
    used = np.flatnonzero(w[number])
    keys = np.unique((owner[used] << how.bits) | number[used])
    return np.bincount(keys >> how.bits, w[keys & ((1 << how.bits) - 1)], len(texts)) + w[0]


def _shared(df: DataFrame, weights: Sequence[tuple[int, float]], how: Settings):
    """The weights, broadcast as one float per feature number (4 MiB at 20 bits)."""
    dense = np.zeros(1 << how.bits, np.float32)
    for k, w in weights:
        dense[k] = w
    return df.sparkSession.sparkContext.broadcast(dense)


def score(documents: DataFrame, weights: Sequence[tuple[int, float]], how: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score, one row per row of documents.  Null and empty texts get the bias's score."""
    shared = _shared(documents, weights, how)
    id_type = documents.schema[id_col].dataType

    def run(batches):
        w = shared.value
        for ids, texts in text_slices(batches, "__id", "__text"):
            total = _totals(texts, w, how)
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_type), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[id_col, "score"])

    arrow_type = to_arrow_type(id_type)
    rows = documents.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    return rows.mapInArrow(run, StructType([StructField(id_col, id_type), StructField("score", DoubleType())]))


def toxicity(documents: DataFrame, labels: DataFrame, how: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the fit sees only labels of rows that aren't held out."""
    weights = train(documents, labels.where(~held_out("doc_id")), how)
    return score(documents, weights, how).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, weights: Sequence[tuple[int, float]], how: Settings = Settings()) -> DataFrame:
    """documents (with all columns) without those that score THRESHOLD or more; in one pass, without a join."""
    shared = _shared(documents, weights, how)
    limit = np.log(THRESHOLD / (1 - THRESHOLD))

    def run(batches):
        w = shared.value
        for batch in batches:
            keep = []
            for _, texts in text_slices([batch], "text", "text"):
                keep.append(_totals(texts, w, how) < limit)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return documents.mapInArrow(run, documents.schema)
