"""Canvas, screen and label expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the viewer: canvas side, picture box, click tolerance, shrink limit, screen margin.
CANVAS = 16384
BOX = 75
TOLERANCE = 20
SHRINK_ABOVE = 4000
MARGIN = 40


def extent(points: DataFrame, *by: str) -> DataFrame:
    """Smallest and largest x and y, per group if ``by`` is given."""
    return points.groupBy(*by).agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )


def _extent_value(points: DataFrame) -> Column:
    """The extent as one scalar subquery: no join, and the rows are not shuffled."""
    return extent(points).select(F.struct("min_x", "max_x", "min_y", "max_y").alias("e")).scalar()


def _to_canvas(v: Column, lo: Column, hi: Column, side: int) -> Column:
    span = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    return F.bround((v - lo) / span * F.lit(float(side - 1))).cast("int")


def canvas_normalise(points: DataFrame, side: int = CANVAS) -> DataFrame:
    """Integer canvas position viz_x, viz_y in [0, side-1], rounding halves to even."""
    e = _extent_value(points)
    return canvas_positions(points, {c: e[c] for c in ("min_x", "max_x", "min_y", "max_y")}, side)


def canvas_positions(points: DataFrame, e: dict[str, Column] | None = None, side: int = CANVAS) -> DataFrame:
    """Canvas positions by a given extent, or by the columns of one beside every point."""
    e = e or {c: F.col(c) for c in ("min_x", "max_x", "min_y", "max_y")}
    return points.withColumns({
        "viz_x": _to_canvas(F.col("x"), e["min_x"], e["max_x"], side),
        "viz_y": _to_canvas(F.col("y"), e["min_y"], e["max_y"], side),
    })


def _scaled(e: Column, width: float, height: float, margin: float) -> tuple[Column, Column]:
    size = F.lit(float(min(width, height) - 2 * margin))
    w, h = e["max_x"] - e["min_x"], e["max_y"] - e["min_y"]
    m = F.lit(float(margin))
    aspect = F.when((h == 0) | (w == 0), F.lit(1.0)).otherwise(w / h)
    # A domain without width maps to the middle of its range.
    tx = F.when(w == 0, F.lit(0.5)).otherwise((F.col("x") - e["min_x"]) / w)
    ty = F.when(h == 0, F.lit(0.5)).otherwise((F.col("y") - e["min_y"]) / h)
    return m + tx * size * aspect, m + size - ty * size


def screen_scale(points: DataFrame, full=(CANVAS, CANVAS), split=(CANVAS // 2, CANVAS), margin: float = MARGIN) -> DataFrame:
    """Bitmap coordinates for the full and the split view; y grows downwards, aspect ratio kept."""
    e = _extent_value(points)
    fx, fy = _scaled(e, *full, margin)
    sx, sy = _scaled(e, *split, margin)
    return points.withColumns({"full_x": fx, "full_y": fy, "split_x": sx, "split_y": sy})


def bounds_box(points: DataFrame, x: str, y: str, size: float = BOX) -> DataFrame:
    """Box of side ``size`` centred on (x, y)."""
    half = F.lit(size / 2.0)
    return (
        points.withColumn("box_x", F.col(x) - half)
        .withColumn("box_y", F.col(y) - half)
        .withColumn("box_w", F.lit(float(size)))
        .withColumn("box_h", F.lit(float(size)))
    )


def fit_scale(width: float, height: float, bitmap_w: float = CANVAS, bitmap_h: float = CANVAS) -> float:
    return min(width / bitmap_w, height / bitmap_h)


def viewport_query(boxes: DataFrame, width: float, height: float, k: float, tx: float, ty: float) -> DataFrame:
    """Boxes that overlap the screen under zoom ``k`` and shift (tx, ty), with their screen corner."""
    x0, y0 = -tx / k, -ty / k
    x1, y1 = (width - tx) / k, (height - ty) / k
    seen = (
        (F.col("box_x") <= x1) & (F.col("box_x") + F.col("box_w") >= x0)
        & (F.col("box_y") <= y1) & (F.col("box_y") + F.col("box_h") >= y0)
    )
    return (
        boxes.filter(seen)
        .withColumn("screen_x", F.col("box_x") * F.lit(float(k)) + F.lit(float(tx)))
        .withColumn("screen_y", F.col("box_y") * F.lit(float(k)) + F.lit(float(ty)))
    )


def thumb_scale(n: Column, above: int = SHRINK_ABOVE) -> Column:
    """Picture shrink factor: 1 up to ``above`` pictures, sqrt(above / n) beyond."""
    return F.when(n > above, F.sqrt(F.lit(float(above)) / n)).otherwise(F.lit(1.0))


def run_label(runs: DataFrame, method: str, keys: list[str]) -> Column:
    """Caption of a run: METHOD (config i): key=value, ... in schema order; unset values read None."""
    parts = [
        F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("None"))) for k in keys
    ]
    head = F.concat(F.lit(f"{method.upper()} (config "), F.col("config_id").cast("string"), F.lit("): "))
    return F.concat(head, F.concat_ws(", ", *parts))
