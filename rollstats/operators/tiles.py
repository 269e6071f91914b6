"""Connected regions of images of any size: labels inside tiles, joined across their borders."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from .components import components

#: Pixels along a tile's side.
TILE = 256
_STEPS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def _fill(g: pd.DataFrame) -> pd.DataFrame:
    """The 8-connected regions of one tile's pixels, each named by its first pixel in reading order."""
    left, out = dict.fromkeys(sorted(zip(g["y"].tolist(), g["x"].tolist()))), []
    for start in list(left):
        if start not in left:
            continue
        todo = deque([start])
        del left[start]
        while todo:
            y, x = todo.popleft()
            out.append((y, x, *start))
            for dy, dx in _STEPS:
                if (y + dy, x + dx) in left:
                    del left[y + dy, x + dx]
                    todo.append((y + dy, x + dx))
    labelled = pd.DataFrame(out, columns=["y", "x", "at_y", "at_x"])
    labelled.insert(0, "image", g["image"].iloc[0])
    return labelled


def regions(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """``(image, y, x, region_y, region_x)`` of ``pixels(image, y, x)``: 8-connected regions, each named by its first pixel.

    A tile is filled in one task: ``tile`` squared pixels at most, whatever the image.  Pixels at tiles' borders
    that touch one in another tile link the two tiles' regions, and linked regions are the components of that table: its size goes with
    the borders, not with the areas.  Repeated pixels count once.
    """
    kind = dict(pixels.dtypes)["image"]
    tiled = pixels.select("image", F.col("y").cast("long"), F.col("x").cast("long")).distinct()
    tiled = tiled.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})
    schema = f"image {kind}, y long, x long, at_y long, at_x long"
    filled = stored(tiled.groupBy("image", "ty", "tx").applyInPandas(_fill, schema))
    # Components are of strings that sort like (image, y, x): signs and widths are fixed.
    name = lambda y, x: F.concat_ws(":", F.format_string("%020d", y + (1 << 40)), F.format_string("%020d", x + (1 << 40)), F.col("image").cast("string"))
    edge = [F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1) for c in ("y", "x")]
    border = stored(filled.where(edge[0] | edge[1]).select("image", "y", "x", name(F.col("at_y"), F.col("at_x")).alias("at")))
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _STEPS if (dy, dx) > (0, 0)))
    beside = border.withColumn("s", F.explode(steps)).select("image", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("at").alias("a"))
    links = beside.join(border.withColumnRenamed("at", "b"), ["image", "y", "x"]).where("a != b").select("a", "b").distinct()
    roots = components(links)
    whole = filled.withColumn("node", name(F.col("at_y"), F.col("at_x"))).join(roots, "node", "left")
    first = lambda k, own: F.coalesce(F.split("component", ":", 3)[k].cast("long") - (1 << 40), F.col(own))
    return whole.select("image", "y", "x", first(0, "at_y").alias("region_y"), first(1, "at_x").alias("region_x"))


def boxes(labelled: DataFrame) -> DataFrame:
    """``(image, region_y, region_x, npx, y_min, y_max, x_min, x_max)``: what the region rules look at."""
    return labelled.groupBy("image", "region_y", "region_x").agg(
        F.count(F.lit(1)).alias("npx"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min("x").alias("x_min"), F.max("x").alias("x_max")
    )
