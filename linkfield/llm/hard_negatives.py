"""Hard negatives by lists that the members of a cluster of anchors share.

Anchors are clustered by angle.  For a cluster, candidates are sorted once by the highest score that any member can give
them: their length times the cosine of their angle to the centre less the cluster's radius.  Every member walks that
list, scores what it meets exactly, and ends where the bound can no longer change its result.

Rows are dealt to cells by nearest centre and cells to blocks, anchors to bundles of clusters; a bundle meets the blocks
of those cells that its scores can need, in one task each.  First come the cells around a bundle's own clusters, which
give the scores that the rest is judged by; with the positives known, so is the least score of a negative.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shared_dir, small, written
from .quantised import matrix, of_one_length, quantised

#: Anchors that centres are fitted to (first by hash), components that these have together, centres, rounds of the fit.
SAMPLE, SAMPLE_VALUES, CENTRES, FIT_ROUNDS = 4096, 1 << 20, 256, 6

#: Anchors a cluster has on average, anchors in a bundle, candidates in a block.
MEMBERS, BUNDLE, BLOCK = 64, 4096, 16384

#: Candidates that a list is walked by at first and at most.
STEP, LONGEST_STEP = 512, 8192

NEVER = -(1 << 62)


def fit_centres(vectors: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Unit vectors that the directions of vectors gather around."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = (vectors / np.maximum(norm, 1e-300))[norm[:, 0] > 0]
    if not len(unit):
        return np.eye(1, vectors.shape[1])
    centres = unit[np.random.default_rng(seed).permutation(len(unit))[:k]]
    for _ in range(FIT_ROUNDS):
        sums = np.zeros_like(centres)
        np.add.at(sums, (unit @ centres.T).argmax(1), unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-300), centres)
    return centres


def _angles(vectors: np.ndarray, norm: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centres.T / np.where(norm > 0, norm, 1.0)[:, None], -1, 1))


def _placed(centres: np.ndarray):
    """Rows with their nearest centre, the angle to it, and their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = matrix(batch.column("q")).astype(float)
                norm = np.sqrt((q * q).sum(1))
                angles = _angles(q, norm, centres)
                cell = angles.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell]), pa.array(norm)], names=[*batch.schema.names, "cell", "angle", "norm"])

    return run


def highest(length: np.ndarray, angle: np.ndarray, radius: float) -> np.ndarray:
    """No member of a cluster scores candidates higher than its own length times this: angle is theirs to the centre,
    radius the members' greatest.  A bit is added for rounding."""
    return length * (np.cos(np.clip(angle - radius, 0, math.pi)) + 1e-9)


def best_first(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, -score))


class Found:
    """What one anchor has found so far: score, id and row, best first."""

    def __init__(self):
        self.score = self.ids = self.rows = np.empty(0, np.int64)

    def merged(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score, ids, rows = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.rows, rows)))
        order = best_first(score, ids)
        self.score, self.ids, self.rows = score[order], ids[order], rows[order]

    def kept(self, which) -> None:
        self.score, self.ids, self.rows = self.score[which], self.ids[which], self.rows[which]


class Best(Found):
    """The k best of the anchor's own label."""

    def __init__(self, k: int, needed: int, _):
        super().__init__()
        self.k, self.needed, self.most = k, needed, -NEVER

    def add(self, *new: np.ndarray) -> None:
        self.merged(*new)
        self.kept(slice(self.k))
        if len(self.score) == self.k:
            self.needed = max(self.needed, int(self.score[-1]))


class Windows(Found):
    """For every positive's window of scores, the k best of other labels: what windows share is kept once."""

    def __init__(self, k: int, needed: int, windows: list[tuple[int, int]]):
        super().__init__()
        self.k, self.needed, self.windows, self.most = k, needed, windows, max(high for _, high in windows)

    def add(self, *new: np.ndarray) -> None:
        self.merged(*new)
        used, needed, down = np.zeros(len(self.score), bool), [], -self.score
        for low, high in self.windows:
            begin, end = int(np.searchsorted(down, -high, "left")), int(np.searchsorted(down, -low, "right"))
            used[begin : min(end, begin + self.k)] = True
            needed.append(int(self.score[begin + self.k - 1]) if end - begin >= self.k else low)
        self.needed = min(needed)
        self.kept(used)


def walk(members: dict[str, np.ndarray], states: list[Found], candidates: dict[str, np.ndarray], angle: np.ndarray, same_label: bool) -> int:
    """Fills the states of a cluster's members from the list that they share; returns how many scores were computed."""
    bound = highest(candidates["norm"], angle, float(members["angle"].max()))
    order = np.argsort(-bound, kind="stable")
    bound = bound[order]
    exact = members["norm"].max() * candidates["norm"].max(initial=0) < 2.0**52  # sums of such products are exact in doubles
    kind = float if exact else np.int64
    own, computed, at, step = members["q"].astype(kind), 0, 0, STEP
    while at < len(order):
        going = np.flatnonzero(bound[at] * members["norm"] + 1 >= np.array([s.needed for s in states], float))
        if not len(going):
            break
        part = order[at : at + step]
        scores = (own[going] @ candidates["q"][part].astype(kind).T).astype(np.int64)
        computed += scores.size
        ids, rows, labels = candidates["vec_id"][part], candidates["row"][part], candidates["label"][part]
        for i, s in zip(going.tolist(), scores, strict=True):
            state = states[i]
            some = np.flatnonzero((s >= state.needed) & (s <= state.most) & ((labels == members["label"][i]) == same_label) & (rows != members["row"][i]))
            if len(some):
                state.add(s[some], ids[some], rows[some])
        at, step = at + step, min(2 * step, LONGEST_STEP)
    return computed


FOUND = "anchor_row long, anchor_id long, row long, vec_id long, score long"


def _task(centres: np.ndarray, k: int, same_label: bool):
    """One block of candidates and one bundle of anchors."""

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        table = table.combine_chunks()
        plain = {c: table.column(c).to_numpy() for c in ("row", "vec_id", "label", "angle", "norm")}
        return plain | {"q": matrix(table.column("q").combine_chunks() if table.num_rows else pa.array([[0]], pa.list_(pa.int32())))[: table.num_rows]}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            candidates, anchors = columns(left), columns(right)
            cells, needed = right.column("cell").to_numpy(), right.column("needed").to_numpy()
            windows = [[(w["low"], w["high"]) for w in x] for x in right.column("windows").to_pylist()]
            angles = _angles(candidates["q"].astype(float), candidates["norm"], centres[np.unique(cells)])
            for c, cell in enumerate(np.unique(cells).tolist()):
                of = np.flatnonzero(cells == cell)
                states = [(Best if same_label else Windows)(k, int(needed[i]), windows[i]) for i in of]
                walk({n: v[of] for n, v in anchors.items()}, states, candidates, angles[:, c], same_label)
                out += [(np.full(len(s.score), anchors["row"][i]), np.full(len(s.score), anchors["vec_id"][i]), s.rows, s.ids, s.score) for i, s in zip(of, states, strict=True)]
        whole = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.empty(0, np.int64)] * 5
        return pa.table([pa.array(x, pa.int64()) for x in whole], names=["anchor_row", "anchor_id", "row", "vec_id", "score"])

    return run


def _reachable(centres: np.ndarray, cells: dict[int, tuple[float, float]]):
    """Per bundle, the cells of which some row may reach what some of its anchors need; cells: angle and length at most."""
    numbers = np.array(sorted(cells), np.int64)
    reach, length = (np.array([cells[int(c)][i] for c in numbers]) for i in (0, 1))
    between = np.arccos(np.clip(centres @ centres[numbers].T, -1, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(b, int(c)) for b, own, needed, radius, norm in zip(*(x.to_pylist() for x in batch.columns), strict=True) for c in numbers[highest(length * norm, between[own] - reach, radius).clip(0) + 1 >= needed]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32()), strict=True)], names=["bundle", "cell"])

    return run


def _dealt(sizes: dict[int, int], most: int) -> tuple[dict[int, tuple[int, int]], int]:
    """For each cell its first number and how many it has, so that none gets over about `most`; small cells share one."""
    out, at, room = {}, -1, 0
    for cell, n in sorted(sizes.items()):
        if n > most:
            out[cell] = (at + 1, math.ceil(n / most))
            at, room = at + math.ceil(n / most), 0
        else:
            if n > room:
                at, room = at + 1, most
            out[cell], room = (at, 1), room - n
    return out, at + 1


def _number(dealt: dict[int, tuple[int, int]], cell: str, salt: str) -> Column:
    first, n = (F.array(*[F.lit(dealt.get(c, (0, 1))[i]).cast("long") for c in range(max(dealt, default=0) + 1)]) for i in (0, 1))
    return F.get(first, F.col(cell)) + F.pmod(F.xxhash64(salt), F.get(n, F.col(cell)))


def mine(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", n_positives: int = 5, n_negatives: int = 5,
    share: tuple[int, int] = (80, 100), bundle: int = BUNDLE, block: int = BLOCK, members: int = MEMBERS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that `anchors` (a
    condition on vec_id and label) holds for and each of its best rows of the same label, the best rows of other labels
    whose score is share[0] / share[1] of the positive's at least and no higher than it.

    Scores are inner products of floor(256 * x) (components held to +-2^22), higher ones first, ties by smaller id; a
    row is never its own partner.  Rows take no part whose id, label or vector is null or whose vector holds null or
    non-finite components.  Shorter vectors are followed by zeros.  Repeated rows and ids are rows of their own, as
    anchors and as partners.  A positive with a score below zero has no negatives (the window is empty).  Without
    anchors, or on an empty table, there are no rows.

    Centres are fitted to at most SAMPLE anchors; they decide what is skipped, never what is found.
    """
    spark = df.sparkSession
    shared_dir(spark)
    taking = quantised(df, id_col, vec_col, label_col).where("vec_id is not null and label is not null")
    rows, length = of_one_length(written(taking.withColumn("row", F.monotonically_increasing_id()), "integers"))
    some = rows.where(anchors).orderBy(F.xxhash64("vec_id", "row"), "row").limit(max(1, min(SAMPLE, SAMPLE_VALUES // length)))
    sample = some.select("q").toArrow().column("q")
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not len(sample):
        return none
    centres = fit_centres(matrix(sample.combine_chunks()).astype(float), max(1, min(CENTRES, len(sample) // 4, rows.where(anchors).count() // members)))
    placed = written(rows.mapInArrow(_placed(centres), "vec_id long, label long, q array<int>, row long, cell int, angle double, norm double"), "placed")
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(anchors).alias("n_anchors"), F.max("angle").alias("angle"), F.max("norm").alias("norm")).collect()
    blocks, n_blocks = _dealt({r.cell: r.n for r in stats}, block)
    bundles, _ = _dealt({r.cell: r.n_anchors for r in stats if r.n_anchors}, bundle)
    cells = {r.cell: (r.angle, r.norm) for r in stats}
    asking = written(placed.where(anchors).withColumn("bundle", _number(bundles, "cell", "row")), "anchors")
    own = written(asking.select("bundle", "cell").distinct(), "own")
    of_cell = spark.createDataFrame([(c, first + i) for c, (first, n) in blocks.items() for i in range(n)], "cell int, block long")

    def walked(asking: DataFrame, pairs: DataFrame, k: int, same_label: bool) -> DataFrame:
        candidates = placed.withColumn("block", _number(blocks, "cell", "row")).join(small(pairs, 16), "cell")
        met = small(pairs.join(F.broadcast(of_cell), "cell").select("bundle", "block").distinct(), 16)
        left = candidates.select("bundle", "block", "row", "vec_id", "label", "angle", "norm", "q").groupBy("bundle", "block")
        right = asking.join(met, "bundle").select("bundle", "block", "row", "vec_id", "label", "angle", "norm", "q", "cell", "needed", "windows").groupBy("bundle", "block")
        return left.cogroup(right).applyInArrow(_task(centres, k, same_label), FOUND)

    def best(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "vec_id", "row")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    def pairs_of(asking: DataFrame) -> DataFrame:
        needs = asking.groupBy("bundle", "cell").agg(F.min("needed").alias("needed"), F.max("angle").alias("angle"), F.max("norm").alias("norm"))
        return needs.mapInArrow(_reachable(centres, cells), "bundle long, cell int").distinct()

    empty = F.expr("array()").cast("array<struct<low:bigint,high:bigint>>")
    near = written(best(walked(asking.withColumns({"needed": F.lit(NEVER), "windows": empty}), own, n_positives, True), n_positives), "near")
    least = near.where(F.col("place") == n_positives).select(F.col("anchor_row").alias("row"), F.col("score").alias("needed"))
    asking_on = asking.join(least, "row", "left").withColumns({"needed": F.coalesce("needed", F.lit(NEVER)), "windows": empty})
    rest = written(pairs_of(asking_on).join(own.select("bundle", "cell").distinct(), ["bundle", "cell"], "left_anti"), "rest")
    positives = near.drop("place")
    if not rest.isEmpty():
        positives = positives.unionByName(walked(asking_on, rest, n_positives, True))
    positives = written(best(positives, n_positives).drop("place"), "positives")

    low = F.expr(f"(score * {share[0]} + {share[1] - 1}) div {share[1]}")  # rounded up: scores are zero or more here
    window = F.struct(low.alias("low"), F.col("score").alias("high"))
    windows = positives.where("score >= 0").groupBy(F.col("anchor_row").alias("row")).agg(F.sort_array(F.collect_set(window)).alias("windows"), F.min(low).alias("needed"))
    judging = asking.join(windows, "row")
    negatives = written(walked(judging, written(pairs_of(judging), "reachable"), n_negatives, False), "negatives")
    chosen = positives.where("score >= 0").select("anchor_row", "anchor_id", F.col("row").alias("positive_row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), low.alias("low"))
    both = chosen.join(negatives.select("anchor_row", F.col("row").alias("negative_row"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), "anchor_row")
    order = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    ranked = both.where("negative_score between low and positive_score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
