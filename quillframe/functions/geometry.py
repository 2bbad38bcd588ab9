"""Box geometry as Column functions; a box is four columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CANVAS = 512.0
BOX = ("x0", "y0", "x1", "y1")


def box(prefix: str = "", names=BOX) -> tuple[Column, ...]:
    """The four columns of a box whose names begin with a prefix."""
    return tuple(F.col(prefix + n) for n in names)


def center_x(b) -> Column:
    return (b[0] + b[2]) / 2


def center_y(b) -> Column:
    return (b[1] + b[3]) / 2


def _side(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), high - low)


def area(b) -> Column:
    """Width times height; a reversed side counts as zero."""
    return _side(b[0], b[2]) * _side(b[1], b[3])


def intersection(a, b) -> Column:
    return _side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * _side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))


def apart(a, b) -> Column:
    """Whether two boxes surely share no area; cheaper than their intersection, for inner loops. False where coordinates are null."""
    return F.coalesce((a[2] <= b[0]) | (b[2] <= a[0]) | (a[3] <= b[1]) | (b[3] <= a[1]), F.lit(False))


def iou(a, b) -> Column:
    """Intersection over union; 0 where the union is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def ioa(a, b) -> Column:
    """Intersection over the smaller area; 0 where that is empty."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(F.lit(0.0))


def spans_overlap(a, b) -> Column:
    """Whether the x-spans share a point; touching counts."""
    return (a[0] <= b[2]) & (b[0] <= a[2])


def gap(a, b) -> Column:
    """Distance between two boxes; 0 where they touch or overlap."""
    dx = F.greatest(F.lit(0.0), a[0] - b[2], b[0] - a[2])
    dy = F.greatest(F.lit(0.0), a[1] - b[3], b[1] - a[3])
    return F.hypot(dx, dy)


def diagonal(b) -> Column:
    return F.hypot(b[2] - b[0], b[3] - b[1])


def clipped(b, size: float = CANVAS) -> tuple[Column, ...]:
    """The box inside a square canvas."""
    return tuple(F.least(F.lit(size), F.greatest(F.lit(0.0), c)) for c in b)


def cell(pixel: Column, origin, pitch, n) -> Column:
    """Grid cell of a pixel coordinate, clamped to 0 .. n - 1."""
    return F.greatest(F.lit(0), F.least(n - 1, F.floor((pixel - origin) / pitch))).cast("int")


def cell_rect(x: Column, y: Column, origin_x, origin_y, pitch_x, pitch_y) -> tuple[Column, ...]:
    """Pixel rectangle of a grid cell."""
    x0, y0 = origin_x + x * pitch_x, origin_y + y * pitch_y
    return x0, y0, x0 + pitch_x, y0 + pitch_y


def rotated(b, degrees: Column, size: float = CANVAS) -> tuple[Column, ...]:
    """Axis-aligned box around the four corners turned about the canvas centre, clipped to the canvas."""
    c, turn = size / 2, F.radians(degrees)
    cos, sin = F.cos(turn), F.sin(turn)
    corners = [(b[i] - c, b[j] - c) for i in (0, 2) for j in (1, 3)]
    xs = [x * cos - y * sin + c for x, y in corners]
    ys = [x * sin + y * cos + c for x, y in corners]
    return clipped((F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)), size)
