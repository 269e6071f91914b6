"""Finding the die in a photo: difference with a reference image, region search, crop."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

RESULT = "file string, not_found string, x_min int, y_min int, x_max int, y_max int, npx long"


def smaller(image: np.ndarray, factor: int) -> np.ndarray:
    """The image at 1/``factor`` of its size, each pixel the one at the middle of its place."""
    rows, columns = ((np.arange(n // factor) + 0.5) * (n / (n // factor)) for n in image.shape[:2])
    return image[rows.astype(int)[:, None], columns.astype(int)]


def difference(image: np.ndarray, reference: np.ndarray, factor: int) -> np.ndarray:
    """Summed channel differences of both images made smaller."""
    if image.shape != reference.shape:
        raise ValueError(f"image is {image.shape}, reference {reference.shape}")
    if min(image.shape[:2]) < factor:
        raise ValueError(f"image is {image.shape}, too small for a factor of {factor}")
    return np.abs(smaller(image, factor).astype(int) - smaller(reference, factor).astype(int)).sum(axis=2)


def _region(hot: np.ndarray, seen: np.ndarray, seeds: list[tuple[int, int]]) -> tuple[int, int, int, int, int]:
    """The 8-connected regions around (x, y) seeds as one: pixels, and their box."""
    todo, n, box = deque(seeds), 0, [*seeds[0], *seeds[0]]
    for x, y in seeds:
        seen[y, x] = True
    while todo:
        i, j = todo.popleft()
        n += 1
        box = [min(box[0], i), min(box[1], j), max(box[2], i), max(box[3], j)]
        for b in range(max(0, j - 1), min(hot.shape[0], j + 2)):
            for a in range(max(0, i - 1), min(hot.shape[1], i + 2)):
                if not seen[b, a]:
                    seen[b, a] = True
                    if hot[b, a]:
                        todo.append((a, b))
    return n, *box


def find_die(diff: np.ndarray, distance: int, threshold: int) -> dict:
    """Box of the first region of a die's shape, or why there is none.

    Every ``distance``-th row is scanned.  Regions are looked for where more than
    half of ``distance`` among the last twice that many scanned pixels differ, around all
    that differ among the last half of ``distance``; one of the wrong shape is passed over,
    one far too large gives the image up.  The scan goes on from row to row, and starts
    anew after a region.
    """
    hot, seen, target = diff > threshold, np.zeros(diff.shape, dtype=bool), distance * distance
    half, size = distance // 2, 2 * distance
    before: list[tuple[int, int, bool]] = []  # the scanned pixels that the window still holds, from earlier rows
    for y in range(half, diff.shape[0], distance):
        x = 0
        while x < diff.shape[1]:
            fresh = hot[y, x:] & ~seen[y, x:]
            flags = np.r_[np.array([f for *_, f in before], dtype=bool), fresh]
            total = np.r_[0, np.cumsum(flags)]
            ends = np.arange(len(before), len(flags)) + 1
            held = total[ends] - total[np.maximum(ends - size, 0)]
            full = np.flatnonzero(fresh & (held > half))
            scanned = [(k, y, bool(f)) for k, f in zip(range(x, diff.shape[1]), fresh)]
            if not len(full):
                before = [*before, *scanned][-size:]
                break
            last = int(full[0])
            window = [*before, *scanned[: last + 1]][-size:]
            n, x0, y0, x1, y1 = _region(hot, seen, [(i, j) for i, j, f in window[-half or None :] if f])
            if n > scalars.ABORT_PIXELS * target:
                return {"not_found": f"region of {n} pixels"}
            dx, dy = x1 - x0, y1 - y0
            ratio = dx / dy if dy >= scalars.TINY else 0
            stretched = max(ratio, 1 / ratio) if ratio >= scalars.TINY else scalars.INF
            fits = scalars.AREA_LOW * target <= dx * dy < scalars.AREA_HIGH * target and n >= scalars.MIN_PIXELS * target
            if stretched < scalars.MAX_ECCENTRICITY and fits:
                return {"x_min": x0, "y_min": y0, "x_max": x1, "y_max": y1, "npx": n}
            before, x = [], x + last + 1
    return {"not_found": "no region"}


def _pixels(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)


def detect(images: DataFrame, reference: tuple[int, int, int, bytes], distance: int, threshold: int = 180, factor: int = 6) -> DataFrame:
    """One result a photo of ``images(file, width, height, channels, data)``; failures are rows, never exceptions.

    ``reference`` is one photo (width, height, channels, data).  Bounds are in photo pixels.
    """
    shared = images.sparkSession.sparkContext.broadcast(reference)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = _pixels(*shared.value)
        for b in batches:
            out = []
            for file, w, h, c, data in zip(b["file"], b["width"], b["height"], b["channels"], b["data"]):
                try:
                    got = find_die(difference(_pixels(w, h, c, data), ref, factor), distance, threshold)
                except ValueError as e:
                    got = {"not_found": str(e)}
                scaled = {k: v * factor if k != "npx" else v for k, v in got.items() if k != "not_found"}
                out.append({"file": file, "not_found": got.get("not_found"), **scaled})
            frame = pd.DataFrame(out, columns=["file", "not_found", "x_min", "y_min", "x_max", "y_max", "npx"])
            yield frame.astype({k: "Int64" for k in ("x_min", "y_min", "x_max", "y_max", "npx")})

    return images.select("file", "width", "height", "channels", "data").mapInPandas(run, RESULT)


def crop_bounds(found: DataFrame, width: int, height: int, length: int = 660) -> DataFrame:
    """Adds ``crop_x`` and ``crop_y``: the square of side ``length`` around each box."""
    return found.withColumns({
        "crop_x": scalars.squared(F.col("x_min"), F.col("x_max"), F.lit(width), F.lit(length)),
        "crop_y": scalars.squared(F.col("y_min"), F.col("y_max"), F.lit(height), F.lit(length)),
    })


#: Outlines are drawn of more results than this.
OVERLAY_AFTER = 10


def overlay(found: DataFrame) -> DataFrame:
    """``(file, x, y, radius_x, radius_y)``: the ellipses of the overview of all boxes; none for a few results only."""
    boxes = found.where("not_found is null")
    enough = boxes.agg((F.count(F.lit(1)) > OVERLAY_AFTER).alias("enough"))
    middle = lambda a: (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2
    radius = lambda a: (F.col(f"{a}_max") - F.col(f"{a}_min")) / 2
    rows = boxes.select("file", middle("x").alias("x"), middle("y").alias("y"), radius("x").alias("radius_x"), radius("y").alias("radius_y"))
    return rows if enough.first().enough else rows.limit(0)
