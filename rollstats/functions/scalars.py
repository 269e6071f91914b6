"""Scalar formulas as columns: regions, bounds, proportions, verdicts, p-values, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")

#: A region is valid if its box is not stretched by this factor or more ...
MAX_ECCENTRICITY = 2.0
#: ... its box area lies in [low, high) target areas, and it has this many target areas of pixels.
AREA_LOW, AREA_HIGH, MIN_PIXELS = 2.0, 7.0, 1.5
#: Beyond this many target areas of pixels the whole image is given up.
ABORT_PIXELS = 5.0
#: Below this a length or a ratio counts as zero.
TINY = 1e-3


def eccentricity(dx: Column, dy: Column) -> Column:
    """Ratio of the sides, at least 1; infinite for a degenerate box."""
    dx, dy = dx.cast("double"), dy.cast("double")
    ratio = F.try_divide(dx, dy)
    return F.when((dy < TINY) | (ratio < TINY), F.lit(INF)).otherwise(F.greatest(ratio, F.try_divide(F.lit(1.0), ratio)))


def region_valid(npx: Column, dx: Column, dy: Column, target: Column) -> Column:
    """The acceptance test of a region of ``npx`` pixels in a box of dx by dy."""
    area = dx * dy
    return (
        (eccentricity(dx, dy) < MAX_ECCENTRICITY)
        & (area >= AREA_LOW * target)
        & (area < AREA_HIGH * target)
        & (npx >= MIN_PIXELS * target)
    )


def region_aborts(npx: Column, target: Column) -> Column:
    return npx > ABORT_PIXELS * target


def squared(low: Column, high: Column, limit: Column, length: Column) -> Column:
    """One axis of a box widened on both sides to ``length`` inside [0, limit), as ``struct(low, high)``.

    Widening a step at a time on both sides, each stopping at the border, ends
    where this closed form does: after enough steps for the missing width, or
    for what is missing once one side has stopped.  Longer boxes are cut at the
    high end.  Null where ``length`` can't fit.
    """
    missing = length - (high - low)
    steps = F.greatest(F.ceil(missing / 2).cast("int"), missing - low, missing - (limit - 1 - high), F.lit(0))
    new_low = F.greatest(low - steps, F.lit(0))
    return F.when(length <= limit - 1, F.struct(new_low.alias("low"), (new_low + length).alias("high")))


def feature_proportion(a: Column, b: Column) -> Column:
    """Larger over smaller feature count; infinite if either is 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when((a == 0) | (b == 0), F.lit(INF)).otherwise(F.greatest(F.try_divide(a, b), F.try_divide(b, a)))


def grey(n: Column, most: Column) -> Column:
    """0 to 254 in proportion to the largest cell; 0 if all are empty."""
    return F.coalesce(F.floor(F.try_divide((n * 254).cast("double"), most)).cast("int"), F.lit(0))


# Cells above this grey have darker text, others lighter text, by so much.
TEXT_ABOVE, TEXT_STEP = 100, 40


def text_grey(cell: Column) -> Column:
    """Grey of the text in a heatmap cell of grey ``cell``, so that it can be read on it."""
    return cell + F.when(cell > TEXT_ABOVE, -TEXT_STEP).otherwise(TEXT_STEP)


def verdict(p: Column, fair: Column) -> Column:
    """How a bar differs from the fair line."""
    return F.when(F.abs(p - fair) < 0.001, "within").when(p > fair, "more frequent").otherwise("less frequent")


def percent(p: Column) -> Column:
    """Whole percent, truncated."""
    return (p * 100).cast("int")


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function for a > 0: Stirling's series ten steps up, and the steps back."""
    z = a + 10
    stirling = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    steps = a
    for k in range(1, 10):
        steps = steps * (a + k)
    return stirling - F.log(steps)


def chi2_survival(x: Column, dof: Column) -> Column:
    """P(chi-square with ``dof`` degrees of freedom > x), for any x and dof.

    With a = dof/2 and h = x/2: below a + 1 by the series of the incomplete gamma
    function, above by its continued fraction.  Both converge in a few times sqrt(a)
    steps, and scale by exp(a ln h - h - ln gamma(a)), so nothing overflows.
    """
    a, h = dof.cast("double") / 2, x.cast("double") / 2
    scale = F.exp(a * F.log(h) - h - log_gamma(a))
    steps = F.sequence(F.lit(1), F.ceil(12 * F.sqrt(a) + 150).cast("int"))
    series = F.aggregate(
        steps, F.struct((1 / a).alias("term"), (1 / a).alias("sum")),
        lambda s, k: F.struct((s["term"] * h / (a + k)).alias("term"), (s["sum"] + s["term"] * h / (a + k)).alias("sum")),
    )["sum"]

    def lentz(s: Column, k: Column) -> Column:
        up = -k * (k - a)
        b = s["b"] + 2
        c, d = b + up / s["c"], 1 / (up * s["d"] + b)
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["f"] * c * d).alias("f"))

    b = h + 1 - a
    start = F.struct(b.alias("b"), F.lit(1e300).alias("c"), (1 / b).alias("d"), (1 / b).alias("f"))
    fraction = F.aggregate(steps, start, lentz)["f"]
    above = F.when(h < a + 1, 1 - scale * series).otherwise(scale * fraction)
    return F.when((dof <= 0) | (h <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), above)))


def chi2_line(n: Column, p: Column) -> Column:
    """The published wording of a chi-square test's result; ``p`` is rounded as C does, by its exact binary value (``%f`` here rounds the shortest decimal)."""
    return F.format_string("N=%d p=%s (%d%% chance the data is from a random source)", n, F.format_number(p, 6), percent(p))


def histogram_line(side: Column, p: Column, low: Column, high: Column, fair: Column) -> Column:
    """One text bar: fair marked at column 50, the interval in brackets, the value as ``o``.

    Marks are drawn dash, interval, fair, brackets, value; here the last one
    that covers a column is looked up directly.
    """
    at = lambda v: (F.try_divide(v, fair) * 50).cast("int")
    value, left, right = at(p), at(low), at(high)
    size = 1 + F.greatest(right, F.lit(50))

    def glyph(i: Column) -> Column:
        return (
            F.when(i == value, "o").when(i == right, "]").when(i == left, "[").when(i == 50, "*")
            .when((i > left) & (i < right), "=")
            .when((i >= F.least(F.lit(50), value)) & (i < F.greatest(F.lit(50), value)), "-")
            .otherwise(" ")
        )

    bar = F.array_join(F.transform(F.sequence(F.lit(0), size - 1), glyph), "")
    return F.concat(F.format_string("%2d %.3f ", side, p), bar)


def sign_code(vector: Column, start: int = 1, bits: int = 32) -> Column:
    """Signs of ``bits`` components from ``start`` (1-based) as an integer."""
    # A term a bit: compiled, where functions of arrays are interpreted.
    terms = (F.when(F.get(vector, F.lit(start - 1 + i)) > 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(bits))
    return F.when(vector.isNotNull(), reduce(Column.bitwiseOR, terms))
