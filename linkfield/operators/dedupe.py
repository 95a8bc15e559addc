"""Greedy keep-first dedup: a row goes when a row kept before it is near.  Order matters; a self-join is not the same."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import corners, same_spot, same_text_spot

#: Rows of one group up to which the fold runs as an expression; larger groups look kept boxes up in a grid.
FOLD_ROWS = 200

#: Boxes with sides up to an eighth (two to this power) are of one class.
LEAST_POWER = -3

#: Boxes that are compared one by one; more at once.
FEW = 200


def _numpy_near(text: bool):
    def near(k: np.ndarray, x: np.ndarray) -> np.ndarray:
        w = np.minimum(k[:, 2], x[2]) - np.maximum(k[:, 0], x[0])
        h = np.minimum(k[:, 3], x[3]) - np.maximum(k[:, 1], x[1])
        if text:
            apart = np.abs((k[:, 1] + k[:, 3]) / 2 - (x[1] + x[3]) / 2)
            return (w > 0.5 * np.minimum(k[:, 2] - k[:, 0], x[2] - x[0])) & (apart < np.maximum(k[:, 3] - k[:, 1], x[3] - x[1]))
        smaller = np.minimum((k[:, 2] - k[:, 0]) * (k[:, 3] - k[:, 1]), (x[2] - x[0]) * (x[3] - x[1]))
        return (smaller > 0) & (w > 0) & (h > 0) & (w * h > 0.5 * smaller)

    return near


def _near_one(text: bool):
    """The same for two boxes as tuples."""

    def near(k: tuple, x: tuple) -> bool:
        w = min(k[2], x[2]) - max(k[0], x[0])
        if text:
            apart = abs((k[1] + k[3]) / 2 - (x[1] + x[3]) / 2)
            return w > 0.5 * min(k[2] - k[0], x[2] - x[0]) and apart < max(k[3] - k[1], x[3] - x[1])
        h = min(k[3], x[3]) - max(k[1], x[1])
        return w > 0 and h > 0 and w * h > 0.5 * min((k[2] - k[0]) * (k[3] - k[1]), (x[2] - x[0]) * (x[3] - x[1])) > 0

    return near


class KeptGrid:
    """Kept boxes by size class and cell.

    A class holds boxes whose sides lie between two powers of two; its cells are as large as the largest of them, and a
    box is in the cell of its centre.  So what can be near a box lies in a few cells of each class, and boxes of one
    class that aren't near one another can't crowd a cell."""

    def __init__(self, text: bool):
        self.text, self.near, self.near_many = text, _near_one(text), _numpy_near(text)
        self.boxes: list[tuple[float, float, float, float]] = []
        self.classes: dict[tuple[int, int], dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        self.members: dict[tuple[int, int], list[int]] = defaultdict(list)

    @staticmethod
    def _power(side: float) -> int:
        return max(LEAST_POWER, math.frexp(side)[1]) if side > 0 else LEAST_POWER

    def _candidates(self, x: tuple[float, float, float, float]) -> Iterator[list[int]]:
        """Kept boxes of each class that may be near x: centres no further away than two boxes that touch, or for texts
        the taller's height."""
        w, h, cx, cy = x[2] - x[0], x[3] - x[1], (x[0] + x[2]) / 2, (x[1] + x[3]) / 2
        for (i, j), cells in self.classes.items():
            side_x, side_y = math.ldexp(1.0, i), math.ldexp(1.0, j)
            far_x, far_y = (w + side_x) / 2, max(h, side_y) if self.text else (h + side_y) / 2
            x0, x1, y0, y1 = (cx - far_x) / side_x, (cx + far_x) / side_x, (cy - far_y) / side_y, (cy + far_y) / side_y
            if (x1 - x0 + 2) * (y1 - y0 + 2) > len(cells):
                yield self.members[i, j]
                continue
            out: list[int] = []
            for a in range(math.floor(x0), math.floor(x1) + 1):
                for b in range(math.floor(y0), math.floor(y1) + 1):
                    out += cells.get((a, b), ())
            if out:
                yield out

    def _any_near(self, which: list[int], x: tuple[float, float, float, float]) -> bool:
        if len(which) > FEW:
            return bool(self.near_many(np.array([self.boxes[k] for k in which]), np.array(x)).any())
        return any(self.near(self.boxes[k], x) for k in which)

    def add(self, x: tuple[float, float, float, float]) -> bool:
        """Keeps x unless a kept box is near it; tells whether it did."""
        if any(self._any_near(which, x) for which in self._candidates(x)):
            return False
        i, j = self._power(x[2] - x[0]), self._power(x[3] - x[1])
        cell = math.floor((x[0] + x[2]) / 2 / math.ldexp(1.0, i)), math.floor((x[1] + x[3]) / 2 / math.ldexp(1.0, j))
        self.classes[i, j][cell].append(len(self.boxes))
        self.members[i, j].append(len(self.boxes))
        self.boxes.append(x)
        return True


def kept_rows(boxes: np.ndarray, text: bool) -> list[int]:
    """Numbers of the boxes (rows of x0, y0, x1, y1, in order) that stay.  Boxes turned inside out or without finite
    sides, which no grid holds, are compared with every kept one."""
    sides = np.concatenate([boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]])
    if len(boxes) and np.isfinite(boxes).all() and np.abs(boxes).max() < 2.0**50 and (sides >= 0).all():
        grid = KeptGrid(text)
        return [i for i, x in enumerate(map(tuple, boxes.tolist())) if grid.add(x)]
    near, kept, which = _numpy_near(text), np.empty_like(boxes), []
    for i, x in enumerate(boxes):
        if not near(kept[: len(which)], x).any():
            kept[len(which)] = x
            which.append(i)
    return which


def _kept_numbers(text: bool):
    @F.pandas_udf("array<int>")
    def kept(sides: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else kept_rows(np.asarray(x, float).reshape(-1, 4), text) for x in sides])

    return kept


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str], box: Column, text: bool) -> DataFrame:
    """rows without those near an earlier kept one of their group; box is a struct of x0, y0, x1, y1.

    A group's rows come together as an array in order.  Small groups are folded by an expression, where few boxes are kept
    and looked through; of large ones the sides go through a grid, which gives back the numbers of those that stay.  Both
    read the one array, so there is one plan below."""
    near = same_text_spot if text else same_spot
    grouped = rows.withColumn("__box", box).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, "__box", *[c for c in rows.columns if c not in keys and c not in order]))).alias("__all"))
    large = F.size("__all") > FOLD_ROWS
    sides = F.flatten(F.transform("__all", lambda x: F.array(*[x["__box"][k].cast("double") for k in ("x0", "y0", "x1", "y1")])))
    grouped = grouped.withColumn("__numbers", _kept_numbers(text)(F.when(large, sides)))
    fold = F.aggregate("__all", F.slice("__all", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: near(k["__box"], x["__box"])), kept).otherwise(F.array_append(kept, x)))
    kept = F.when(large, F.transform("__numbers", lambda i: F.get("__all", i))).otherwise(fold)
    return grouped.select(*keys, F.explode(kept).alias("__x")).select(*[c if c in keys else F.col(f"__x.{c}") for c in rows.columns])


def dedupe_qr(hits: DataFrame) -> DataFrame:
    """Codes found at several pyramid levels: of hits with the same payload on the same spot (pixels) the first stays."""
    box = F.struct(F.col("px_left").alias("x0"), F.col("px_top").alias("y0"), F.col("px_right").alias("x1"), F.col("px_bottom").alias("y1"))
    return keep_first(hits, ("doc_id", "page_number", "payload"), ("level_no", "inverted", "decode_no"), box, text=False)


def dedupe_text_spots(candidates: DataFrame) -> DataFrame:
    """Text candidates on one spot of a page, whatever their targets: the first stays, so real text beats OCR."""
    return keep_first(candidates, ("doc_id", "page_number"), ("line_no", "is_bare", "match_no"), corners(), text=True)
