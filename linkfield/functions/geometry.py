"""Column functions over boxes.  A box is a struct of left, bottom, width, height in points, or of pixels with the
origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pixel_box_to_points(box: dict[str, Column], page: tuple[Column, Column], bitmap: tuple[Column, Column]) -> dict[str, Column]:
    """px_left, px_top, px_right, px_bottom on a bitmap as left_pt, bottom_pt, width_pt, height_pt of its page."""
    left, right = box["px_left"] * page[0] / bitmap[0], box["px_right"] * page[0] / bitmap[0]
    top, bottom = page[1] - box["px_top"] * page[1] / bitmap[1], page[1] - box["px_bottom"] * page[1] / bitmap[1]
    return {"left_pt": left, "bottom_pt": bottom, "width_pt": right - left, "height_pt": top - bottom}


def padded_box(points: Column, inverse_scale: Column) -> dict[str, Column]:
    """The box around a code's corners, a fifth of its longer side (4 pixels at least) wider on every side, at full
    size and cut to whole pixels."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    left, right, top, bottom = F.array_min(x), F.array_max(x), F.array_min(y), F.array_max(y)
    pad = F.greatest(F.lit(0.2) * F.greatest(right - left, bottom - top), F.lit(4.0))
    sides = {"px_left": left - pad, "px_top": top - pad, "px_right": right + pad, "px_bottom": bottom + pad}
    return {k: (v * inverse_scale).cast("int") for k, v in sides.items()}


def _shared(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0)


def same_spot(a: Column, b: Column) -> Column:
    """Whether two boxes (struct of x0, y0, x1, y1) share more than half of the smaller one's area."""
    w, h = _shared(a["x0"], a["x1"], b["x0"], b["x1"]), _shared(a["y0"], a["y1"], b["y0"], b["y1"])
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    smaller = F.least(area(a), area(b))
    return (smaller > 0) & (w > 0) & (h > 0) & (w * h > F.lit(0.5) * smaller)


def same_text_spot(a: Column, b: Column) -> Column:
    """Whether two text boxes share more than half of the narrower one's width, with centres closer than the taller
    one's height."""
    w = _shared(a["x0"], a["x1"], b["x0"], b["x1"])
    narrower = F.least(a["x1"] - a["x0"], b["x1"] - b["x0"])
    apart = F.abs((a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2)
    return (w > F.lit(0.5) * narrower) & (apart < F.greatest(a["y1"] - a["y0"], b["y1"] - b["y0"]))


def corners() -> Column:
    """The columns left_pt, bottom_pt, width_pt, height_pt as a struct of x0, y0, x1, y1."""
    return F.struct(F.col("left_pt").alias("x0"), F.col("bottom_pt").alias("y0"), (F.col("left_pt") + F.col("width_pt")).alias("x1"), (F.col("bottom_pt") + F.col("height_pt")).alias("y1"))
