"""Viewer-side lookups and joins over the run catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planisphere.functions.canvas import BOX, TOLERANCE
from planisphere.functions.skew import salted_join
from planisphere.operators.quality import has_name
from planisphere.registry import schema_of

RUN_COLUMNS = ["config_id", "subset_strategy", "subset_size", "runtime"]


def configs_for_method(runs: DataFrame, method: str) -> DataFrame:
    """Typed parameter columns of all runs of a method, newest first."""
    typed = [F.col("params")[p.name].cast(p.sql_type).alias(p.name) for p in schema_of(method)]
    return runs.filter(F.col("method") == method).select(*RUN_COLUMNS, *typed).orderBy(F.col("config_id").desc())


def config_by_id(runs: DataFrame, method: str, config_id: int) -> DataFrame:
    """One run; an error if it does not exist."""
    found = configs_for_method(runs.filter(F.col("config_id") == config_id), method)
    if found.isEmpty():
        raise ValueError(f"no config {config_id} for method {method}")
    return found


def points_for_run(points: DataFrame, method: str, config_id: int) -> DataFrame:
    return points.filter((F.col("method") == method) & (F.col("config_id") == config_id)).select(
        "point_id", "item_id", "group_key", "x", "y"
    )


def viz_list(viz: DataFrame) -> DataFrame:
    """All visualisations, newest first, without their id lists."""
    return viz.select("viz_id", "method", "config_id", "low_res", "created_at").orderBy(F.col("viz_id").desc())


def viz_by_id(viz: DataFrame, viz_id: int) -> DataFrame:
    return viz.filter(F.col("viz_id") == viz_id)


def viz_points_by_id(viz_points: DataFrame, points: DataFrame, viz_id: int, viz: DataFrame | None = None) -> DataFrame:
    """Canvas points of one visualisation with the item id the viewer needs.

    ``viz`` says which run the visualisation shows, so that only the points of that run are read.
    """
    chosen = viz_points.filter(F.col("viz_id") == viz_id)
    shown = viz_by_id(viz, viz_id).first() if viz is not None else None
    if shown:
        points = points.filter((F.col("method") == shown["method"]) & (F.col("config_id") == shown["config_id"]))
    return chosen.join(points.select("point_id", "item_id", "group_key"), "point_id", "left")


def artists_all(artists: DataFrame) -> DataFrame:
    known = ["name", "years", "genre", "nationality", "bio", "wikipedia", "paintings"]
    return artists.select(*[c for c in known if c in artists.columns])


def attach_coords(meta: DataFrame, coords: DataFrame, key: str = "item_id", check: bool = True) -> DataFrame:
    """Metadata joined with coordinates by id; a lost or doubled row is an error."""
    joined = meta.join(coords, key)
    if check:
        want, left, got = meta.count(), coords.count(), joined.count()
        if not want == left == got:
            raise ValueError(f"{want} rows of metadata, {left} of coordinates, {got} matched")
    return joined


def attach_artist(points: DataFrame, artists: DataFrame, rows: int | None = None) -> DataFrame:
    """Every point with its artist record, null if there is none; the first record per name counts.

    One artist may own a large share of the points, so that key is salted.
    """
    others = [c for c in artists.columns if c != "name"]
    first = artists.groupBy("name").agg(F.min_by(F.struct(*others), F.struct(*others)).alias("artist"))
    rows = rows if rows is not None else points.count()
    many = points.withColumnRenamed("group_key", "name")
    joined = salted_join(many, first, "name", rows, "point_id", how="left")
    return joined.withColumnRenamed("name", "group_key").select(
        *points.columns, *[F.col("artist")[c].alias(c) for c in others]
    )


CELL = 128.0


def _cells(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / CELL), F.floor(hi / CELL)))


def hit_test(boxes: DataFrame, clicks: DataFrame, k: float = 1.0, tx: float = 0.0, ty: float = 0.0,
             left: float = 0.0, top: float = 0.0, tolerance: float = TOLERANCE, clicks_n: int | None = None) -> DataFrame:
    """First point (smallest id) whose box, widened by ``tolerance``, holds each click.

    Boxes and clicks meet on grid cells, never as a plain range join. Boxes at one
    position and clicks at one position are merged first: canvas positions are
    whole pixels, so a cell holds at most 128 x 128 different boxes, however many
    points share it.
    """
    at = clicks.select(
        "click_id",
        F.struct(
            ((F.col("client_x") - left - tx) / k).alias("x"), ((F.col("client_y") - top - ty) / k).alias("y")
        ).alias("pos"),
    )
    spots = boxes.groupBy("box_x", "box_y", "box_w", "box_h").agg(F.min("point_id").alias("point_id"))
    x0, x1 = F.col("box_x") - tolerance, F.col("box_x") + F.col("box_w") + tolerance
    y0, y1 = F.col("box_y") - tolerance, F.col("box_y") + F.col("box_h") + tolerance
    wide = (
        spots.select("point_id", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
        .withColumn("cx", _cells(F.col("x0"), F.col("x1")))
        .withColumn("cy", _cells(F.col("y0"), F.col("y1")))
    )
    cell = F.struct("cx", "cy")
    places = at.select("pos").distinct().select(
        "pos", F.floor(F.col("pos.x") / CELL).alias("cx"), F.floor(F.col("pos.y") / CELL).alias("cy")
    ).withColumn("cell", cell).drop("cx", "cy")
    inside = (
        (F.col("pos.x") >= F.col("x0")) & (F.col("pos.x") <= F.col("x1"))
        & (F.col("pos.y") >= F.col("y0")) & (F.col("pos.y") <= F.col("y1"))
    )
    rows = clicks_n if clicks_n is not None else clicks.count()
    # A cell may be clicked in very many places: those rows are spread, the boxes of the cell follow.
    met = salted_join(places, wide.withColumn("cell", cell).drop("cx", "cy"), "cell", rows, "pos")
    hits = met.filter(inside).groupBy("pos").agg(F.min("point_id").alias("point_id"))
    return salted_join(at, hits, "pos", rows, "click_id", how="left").select("click_id", "point_id")


def mosaic_layout(points: DataFrame, scale: Column | float = 1.0, width: int = BOX, height: int = BOX,
                  side: int = 16384) -> DataFrame:
    """Picture boxes clipped to the canvas; a picture with a larger id covers earlier ones."""
    factor = scale if isinstance(scale, Column) else F.lit(float(scale))
    w = F.greatest(F.floor(F.lit(float(width)) * factor), F.lit(1)).cast("int")
    h = F.greatest(F.floor(F.lit(float(height)) * factor), F.lit(1)).cast("int")
    named = points.filter(has_name(F.col("item_id"))) if "item_id" in points.columns else points
    return named.select(
        "point_id",
        F.col("viz_x").alias("x0"), F.col("viz_y").alias("y0"),
        F.least(F.col("viz_x") + w, F.lit(side)).cast("int").alias("x1"),
        F.least(F.col("viz_y") + h, F.lit(side)).cast("int").alias("y1"),
    )


def mosaic_top(layout: DataFrame, cell: int = 64) -> DataFrame:
    """The picture on top of every canvas cell the pictures touch."""
    first_x, last_x = F.col("x0") / cell, (F.col("x1") - 1) / cell
    first_y, last_y = F.col("y0") / cell, (F.col("y1") - 1) / cell
    spots = layout.groupBy("x0", "y0", "x1", "y1").agg(F.max("point_id").alias("point_id"))
    return (
        spots.withColumn("cx", F.explode(F.sequence(F.floor(first_x), F.floor(last_x))))
        .withColumn("cy", F.explode(F.sequence(F.floor(first_y), F.floor(last_y))))
        .groupBy("cx", "cy").agg(F.max("point_id").alias("top_point"))
    )


def density_tiles(points: DataFrame, zooms: list[int], bits: int = 14) -> DataFrame:
    """Point count and a representative per tile and zoom level.

    The finest level is counted from the points; coarser levels roll up its tiles,
    so the points are shuffled once.
    """
    finest = max(zooms)
    shift = bits - finest
    base = points.groupBy(
        F.shiftright("viz_x", shift).alias("tx"), F.shiftright("viz_y", shift).alias("ty")
    ).agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("first_point"))
    levels = F.explode(F.array(*[F.lit(z) for z in sorted(zooms)])).alias("z")
    up = (F.lit(finest) - F.col("z")).cast("int")
    return (
        base.select("*", levels)
        .groupBy(
            "z",
            F.floor(F.col("tx") / F.pow(F.lit(2.0), up)).cast("int").alias("tx"),
            F.floor(F.col("ty") / F.pow(F.lit(2.0), up)).cast("int").alias("ty"),
        )
        .agg(F.sum("n").alias("n"), F.min("first_point").alias("first_point"))
    )


def runtime_report(runs: DataFrame) -> DataFrame:
    """Number of runs and smallest, mean and largest runtime per method."""
    return runs.groupBy("method").agg(
        F.count(F.lit(1)).alias("runs"), F.min("runtime").alias("min_runtime"),
        F.round(F.avg("runtime"), 6).alias("avg_runtime"), F.max("runtime").alias("max_runtime"),
    )
