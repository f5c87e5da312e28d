"""Geometry of boxes ``[x0, y0, x1, y1]`` on a page of 1000 by 1000, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENT = 1000.0


def part(box: Column, i: int) -> Column:
    return F.try_element_at(box, F.lit(i + 1))


def contract_box(box: Column, scale_unit: bool = False) -> Column:
    """The box if it is four numbers from 0 to 1000 with a positive size, others null.

    With ``scale_unit`` a box within 1.5 is taken as shares of the page. Values that
    are no integers are rounded to six places.
    """
    if scale_unit:
        box = F.when(F.array_max(box) <= 1.5, F.transform(box, lambda x: x * EXTENT)).otherwise(box)
    sane = (F.size(box) == 4) & F.forall(box, lambda x: F.coalesce((x >= 0) & (x <= EXTENT) & ~F.isnan(x), F.lit(False)))
    return F.when(sane & (part(box, 2) > part(box, 0)) & (part(box, 3) > part(box, 1)), F.transform(box, lambda x: F.round(x, 6)))


def unit_box(box: Column) -> Column:
    """Struct x, y, width, height in shares of the page: by 1 if all are within 1, else by 1000; null if out of bounds."""
    scale = F.when(F.array_max(box) <= 1.0, 1.0).otherwise(EXTENT)
    x0, y0, x1, y1 = (part(box, i) / scale for i in range(4))
    ok = (F.size(box) == 4) & (x0 >= 0) & (y0 >= 0) & (x1 <= 1) & (y1 <= 1) & (x1 > x0) & (y1 > y0)
    return F.when(ok, F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height")))


def area(b: Column) -> Column:
    return (part(b, 2) - part(b, 0)) * (part(b, 3) - part(b, 1))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Distance of two intervals, 0 if they touch."""
    return F.greatest(F.lit(0.0), F.greatest(a0, b0) - F.least(a1, b1))


def x_overlap(a: Column, b: Column) -> Column:
    return overlap(part(a, 0), part(a, 2), part(b, 0), part(b, 2))


def y_overlap(a: Column, b: Column) -> Column:
    return overlap(part(a, 1), part(a, 3), part(b, 1), part(b, 3))


def x_gap(a: Column, b: Column) -> Column:
    return gap(part(a, 0), part(a, 2), part(b, 0), part(b, 2))


def y_gap(a: Column, b: Column) -> Column:
    return gap(part(a, 1), part(a, 3), part(b, 1), part(b, 3))


def width(b: Column) -> Column:
    return part(b, 2) - part(b, 0)


def height(b: Column) -> Column:
    return part(b, 3) - part(b, 1)


def intersection(a: Column, b: Column) -> Column:
    return x_overlap(a, b) * y_overlap(a, b)


def intersection_ratio(a: Column, b: Column) -> Column:
    """Shared area over the smaller area."""
    return F.try_divide(intersection(a, b), F.least(area(a), area(b)))


def adjacent(a: Column, b: Column, most_gap: float = 20, share: float = 0.15) -> Column:
    """Close on one axis and overlapping by a share of the smaller size on the other."""
    return ((x_gap(a, b) <= most_gap) & (y_overlap(a, b) >= share * F.least(height(a), height(b)))) | (
        (y_gap(a, b) <= most_gap) & (x_overlap(a, b) >= share * F.least(width(a), width(b)))
    )


def share_extended_band(a: Column, b: Column, most_gap: float = 40, share: float = 0.65) -> Column:
    """As ``adjacent``, with a share of the larger size."""
    return ((y_gap(a, b) <= most_gap) & (x_overlap(a, b) >= share * F.greatest(width(a), width(b)))) | (
        (x_gap(a, b) <= most_gap) & (y_overlap(a, b) >= share * F.greatest(height(a), height(b)))
    )


def neighbours(a: Column, b: Column) -> Column:
    return adjacent(a, b, 65, 0.2)


def caption_score(caption: Column, visual: Column) -> Column:
    """Distance of a caption below or above a visual plus 40 times the share that it misses in width; null if it is too far off."""
    shared = x_overlap(caption, visual) / F.greatest(F.lit(1.0), F.least(width(caption), width(visual)))
    below, above = part(caption, 1) - part(visual, 3), part(visual, 1) - part(caption, 3)
    off = (
        F.when(below >= -20, F.when(F.greatest(below, F.lit(0.0)) <= 100, F.greatest(below, F.lit(0.0))))
        .when(above >= -20, F.when(F.greatest(above, F.lit(0.0)) <= 80, F.greatest(above, F.lit(0.0))))
    )
    return F.when(shared >= 0.55, off + (1 - shared) * 40)


def same_top_band(a: Column, b: Column) -> Column:
    """Two text columns side by side: tops within 45, apart by at most 80, alike in height."""
    ratio = height(b) / height(a)
    return (
        (F.abs(part(a, 1) - part(b, 1)) <= 45) & (x_overlap(a, b) == 0) & (x_gap(a, b) <= 80)
        & (y_overlap(a, b) >= 0.55 * F.least(height(a), height(b))) & ratio.between(0.45, 2.2)
    )


def padded(b: Column, by: float) -> Column:
    """The box with a margin, clipped to the page."""
    lo = lambda i: F.greatest(F.lit(0.0), part(b, i) - by)
    hi = lambda i: F.least(F.lit(EXTENT), part(b, i) + by)
    return F.when(b.isNotNull(), F.array(lo(0), lo(1), hi(2), hi(3)))


def footer_badge(b: Column) -> Column:
    """A small mark near the page's foot."""
    return (part(b, 1) >= 700) & (width(b) <= 100) & (height(b) <= 35) & (area(b) <= 2500)


def touching(a: Column, b: Column) -> Column:
    """Close enough to be parts of one figure, by the narrow or by the broad rule."""
    return adjacent(a, b, 20, 0.15) | share_extended_band(a, b, 40, 0.65)


def conflicting(a: Column, b: Column) -> Column:
    """Two boxes of nearly the same place and size."""
    small, large = F.least(area(a), area(b)), F.greatest(area(a), area(b))
    return (F.try_divide(intersection(a, b), small) > 0.92) & (F.try_divide(large, small) < 1.35)


def aligned(a: Column, b: Column) -> Column:
    """A caption under or over a visual: a fifth of the smaller width is shared, or the centres are near."""
    centre = lambda x: (part(x, 0) + part(x, 2)) / 2
    return (x_overlap(a, b) >= 0.2 * F.least(width(a), width(b))) | (F.abs(centre(a) - centre(b)) <= 180)


def side_score(caption: Column, visual: Column) -> Column:
    """Distance of a caption beside a visual plus 40 times the share that it misses in height; null if it is too far off or of another height."""
    tall = F.greatest(F.lit(1.0), height(visual))
    shared = y_overlap(caption, visual) / F.greatest(F.lit(1.0), F.least(height(caption), height(visual)))
    right, left = part(caption, 0) - part(visual, 2), part(visual, 0) - part(caption, 2)
    off = F.when(right >= -20, F.greatest(right, F.lit(0.0))).when(left >= -20, F.greatest(left, F.lit(0.0)))
    level = F.abs(part(caption, 1) - part(visual, 1)) <= 45
    return F.when((off <= 80) & level & (shared >= 0.55) & (height(caption) / tall).between(0.45, 2.2), off + (1 - shared) * 40)


def caption_score_any_side(caption: Column, visual: Column) -> Column:
    """As ``caption_score``, or beside the visual where that gives none."""
    return F.coalesce(caption_score(caption, visual), side_score(caption, visual))


def loose_unit_box(box: Column) -> Column:
    """Struct x, y, width, height in shares of the page, also beyond its edges; null unless four finite numbers in order."""
    sane = (F.size(box) == 4) & F.forall(box, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    scale = F.when(F.array_max(F.transform(box, F.abs)) <= 1, 1.0).otherwise(EXTENT)
    made = F.struct((part(box, 0) / scale).alias("x"), (part(box, 1) / scale).alias("y"), (width(box) / scale).alias("width"), (height(box) / scale).alias("height"))
    return F.when(sane & (width(box) >= 0) & (height(box) >= 0), made)


def stacked(upper: Column, lower: Column) -> Column:
    """Unit boxes of two paragraphs one below the other in a column."""
    shared = F.greatest(F.lit(0.0), F.least(upper["x"] + upper["width"], lower["x"] + lower["width"]) - F.greatest(upper["x"], lower["x"]))
    share = shared / F.greatest(F.lit(1e-6), F.least(upper["width"], lower["width"]))
    return (share >= 0.62) & (lower["y"] - (upper["y"] + upper["height"])).between(-0.02, 0.12)


def paragraph_place(u: Column) -> Column:
    """Whether a paragraph of the body can stand in a unit box: within the margins, neither too small nor a page wide."""
    inside = (u["x"] >= 0.02) & (u["y"] >= 0.04) & (u["x"] + u["width"] <= 0.98) & (u["y"] + u["height"] <= 0.96)
    return inside & u["width"].between(0.2, 0.7) & u["height"].between(0.025, 0.65)


def large_image(u: Column) -> Column:
    return u["width"] * u["height"] >= 0.08
