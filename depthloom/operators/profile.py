"""Vertical histograms, their peaks, solid cells of a plan view, and rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthloom.functions import geometry as g
from depthloom.options import PlaneOptions


def bin_of(y: Column, low: float, step: float) -> Column:
    """The bin whose edges are low + i * step, by a guess that the edges themselves correct."""
    guess = F.floor((y - g.lit(low)) / g.lit(step)).cast("bigint")
    edge = lambda i: g.lit(low) + i * g.lit(step)
    return F.when(y < edge(guess), guess - 1).when(y >= edge(guess + 1), guess + 1).otherwise(guess)


def grid(points: DataFrame, size: float) -> tuple[float, float, int] | None:
    """Least y, the step between edges, and the number of bins; None without points. A zero range is an error."""
    r = points.agg(F.min("y").cast("double").alias("lo"), F.max("y").cast("double").alias("hi")).first()
    if r["lo"] is None:
        return None
    import math

    step = (r["lo"] + size) - r["lo"]
    bins = math.ceil((r["hi"] + size - r["lo"]) / size) - 1
    if bins < 1:
        raise ValueError("all points lie at one height")
    return r["lo"], step, bins


def vertical_histogram(points: DataFrame, size: float) -> DataFrame:
    """(bin, centre, n) for every bin, empty ones too; the last bin is closed above."""
    found = grid(points, size)
    if found is None:
        return points.sparkSession.createDataFrame([], "bin bigint, centre double, n bigint")
    low, step, bins = found
    # a value on or past the last edge belongs to the last bin if it is not beyond it
    index = bin_of(F.col("y").cast("double"), low, step)
    last = F.col("y").cast("double") == g.lit(low + bins * step)
    counts = points.select(F.when(last, F.lit(bins - 1)).otherwise(index).alias("bin")).filter(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = points.sparkSession.range(bins).withColumnRenamed("id", "b")
    out = every.join(counts, F.col("b") == F.col("bin"), "left")
    return out.select(F.col("b").alias("bin"), (g.lit(low) + F.col("b") * g.lit(step) + g.lit(size / 2)).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))


def peaks(histogram: DataFrame, total: int, options: PlaneOptions = PlaneOptions()) -> DataFrame:
    """(bin, centre, strength) of local maxima of the 3-bin sums, one per plateau; strength is the sum.

    The windows run over the histogram's bins: as many as the scan is high in
    units of hist_bin_m, whatever the number of points.
    """
    half = max(1, round(options.peak_window_m / options.hist_bin_m))
    order = Window.orderBy("bin")
    smooth = histogram.withColumn("s", F.sum("n").over(order.rowsBetween(-1, 1)))
    marked = smooth.withColumn("top", F.max("s").over(order.rowsBetween(-half, half))).withColumn("before", F.lag("s").over(order))
    strong = F.col("s") >= g.lit(options.peak_min_share * total)
    return marked.filter(strong & (F.col("s") == F.col("top")) & (F.col("before").isNull() | (F.col("s") > F.col("before")))).select("bin", "centre", F.col("s").alias("strength"))


def plan_cells(points: DataFrame, size: float, origin: tuple[float, float]) -> DataFrame:
    return points.select(F.floor((F.col("x") - g.lit(origin[0])) / g.lit(size)).cast("bigint").alias("i"), F.floor((F.col("z") - g.lit(origin[1])) / g.lit(size)).cast("bigint").alias("k"))


def plan_origin(points: DataFrame) -> tuple[float, float]:
    r = points.agg(F.min("x").cast("double").alias("x"), F.min("z").cast("double").alias("z")).first()
    return r["x"], r["z"]


def solid_cells(points: DataFrame, size: float, least: int, origin: tuple[float, float] | None = None) -> DataFrame:
    """Cells (i, k) with at least `least` points whose eight neighbours have as many: each dense cell votes for nine."""
    cells = plan_cells(points, size, origin or plan_origin(points))
    dense = cells.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    around = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    votes = dense.select("i", "k", F.explode(around).alias("o")).select((F.col("i") + F.col("o.a")).alias("i"), (F.col("k") + F.col("o.b")).alias("k"))
    return votes.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n")).filter("n = 9").select("i", "k")


def shared_bounds(clouds: list[DataFrame], pad: float = 0.5) -> DataFrame:
    """Whole metres around all clouds in x and z."""
    union = clouds[0].select("x", "z")
    for c in clouds[1:]:
        union = union.unionByName(c.select("x", "z"))
    low = lambda c: F.floor(F.min(c).cast("double") - pad).cast("double")
    high = lambda c: F.ceil(F.max(c).cast("double") + pad).cast("double")
    return union.agg(low("x").alias("x_min"), high("x").alias("x_max"), low("z").alias("z_min"), high("z").alias("z_max"))


def raster(points: DataFrame, across: str, up: str, box: tuple[float, float, float, float], per_metre: int, contrast: int) -> DataFrame:
    """(row, col, n, gray) of a density view, row 0 on top; points outside the box are dropped."""
    x0, x1, y0, y1 = box
    width, height = int((x1 - x0) * per_metre), int((y1 - y0) * per_metre)
    cut = lambda c, low: ((F.col(c) - g.lit(low)) * per_metre).cast("int")  # noqa: E731  towards zero
    at = points.select((F.lit(height - 1) - cut(up, y0)).alias("row"), cut(across, x0).alias("col"))
    inside = at.filter(F.col("col").between(0, width - 1) & F.col("row").between(0, height - 1))
    shade = F.least(g.lit(1), F.log1p(F.col("n").cast("double")) / g.lit(__import__("math").log1p(contrast)))
    return inside.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).withColumn("gray", F.floor(255 - 255 * shade).cast("int"))


def subset_id(options: PlaneOptions = PlaneOptions()) -> Column:
    """Which of the interleaved subsets a point's block falls to."""
    block = lambda c: F.floor(F.col(c) / g.lit(options.subset_block_m)).cast("bigint")
    return F.pmod(block("x") + 2 * block("z"), F.lit(options.subset_count)).cast("int")
