"""Frame ids: listing, selection, gaps, alignment, odometry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthloom.options import CaptureError

#: Sampled frames for statistics, ids shown in messages, and the odometry's columns.
SAMPLED = 8
SHOWN = 20
ODOMETRY = ["timestamp", "frame", "x", "y", "z", "qx", "qy", "qz", "qw"]
FLOAT = r"^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|inf(inity)?|nan)\s*$"
INT = r"^\s*[+-]?\d+(_\d+)*\s*$"


def listed(files: DataFrame, any_case: bool = True) -> DataFrame:
    """file_name with frame_id (null where the name is no number of 32 bits) for the PNG files of a listing."""
    name = F.lower("file_name") if any_case else F.col("file_name")
    digits = F.regexp_extract("file_name", r"(?i)^([0-9]+)\.png$" if any_case else r"^([0-9]+)\.png$", 1)
    return files.filter(F.endswith(name, F.lit(".png"))).select("file_name", F.when(digits != "", digits.try_cast("int")).alias("frame_id"))


def numbered(ids: DataFrame, column: str = "frame_id") -> DataFrame:
    """Ids with their rank from 0. Ranks are dealt out from counts by ranges of ids, so no window spans a large table."""
    span = 1 << 16
    parts = ids.select(F.col(column).alias("id")).withColumn("part", F.floor(F.col("id") / span))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row for each 65536 ids
    own = Window.partitionBy("part").orderBy("id")
    return parts.join(before, F.col("part") == F.col("p")).select("id", (F.col("base") + F.row_number().over(own) - 1).alias("rank"))


def evenly_spaced(ranked: DataFrame, n: int, total: int) -> DataFrame:
    """At most n ids of (id, rank), evenly spaced, ties to even; all if there are no more."""
    if total <= n:
        return ranked
    if n == 1:
        return ranked.filter("rank = 0")
    picks = ranked.sparkSession.range(n).select(F.rint(F.col("id") * F.lit(float(total - 1)) / F.lit(float(n - 1))).cast("bigint").alias("pick")).distinct()
    return ranked.join(F.broadcast(picks), F.col("rank") == F.col("pick"), "left_semi")  # n rows


def select_frames(ids: DataFrame, step: int, most: int | None, column: str = "frame_id") -> DataFrame:
    """Every step-th id, then evenly spaced ones: (id, rank) with ranks anew from 0."""
    if step < 1:
        raise CaptureError("--frame-step must be at least 1")
    if most is not None and most < 1:
        raise CaptureError("--max-frames must be at least 1")
    chosen = numbered(ids, column).filter(F.pmod("rank", F.lit(step)) == 0).withColumn("rank", F.floor(F.col("rank") / step))
    if most is not None:
        chosen = evenly_spaced(chosen, most, chosen.count())
    return numbered(chosen, "id")


def gaps(ids: DataFrame, column: str = "frame_id") -> DataFrame:
    """Runs of absent ids: the id before, the id after, how many are missing."""
    distinct = ids.select(F.col(column).alias("id")).distinct()
    span = 1 << 16
    parts = distinct.withColumn("part", F.floor(F.col("id") / span))
    heads = parts.groupBy("part").agg(F.min("id").alias("head"))
    heads = heads.select(F.col("part").alias("p"), F.lead("head").over(Window.orderBy("part")).alias("after"))
    inner = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    nexts = parts.withColumn("nxt", inner).join(heads, F.col("part") == F.col("p")).select("id", F.coalesce("nxt", "after").alias("next_id"))
    return nexts.filter("next_id > id + 1").select("id", "next_id", (F.col("next_id") - F.col("id") - 1).alias("missing"))


def alignment(a: DataFrame, b: DataFrame, column: str = "frame_id") -> DataFrame:
    """Ids on one side only: frame_id and side ('a' or 'b')."""
    left = a.select(F.col(column).alias("a_id")).distinct()
    right = b.select(F.col(column).alias("b_id")).distinct()
    both = left.join(right, F.col("a_id") == F.col("b_id"), "full_outer")
    return both.filter("a_id IS NULL OR b_id IS NULL").select(F.coalesce("a_id", "b_id").alias("frame_id"), F.when(F.col("b_id").isNull(), "a").otherwise("b").alias("side"))


def is_float(text: Column) -> Column:
    """Whether a cell is a number as Python reads one: blanks around it, underscores, inf and nan allowed."""
    return F.coalesce(F.regexp_like(F.lower(text), F.lit(FLOAT)), F.lit(False))


def is_int(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(INT)), F.lit(False))


def to_double(text: Column) -> Column:
    return F.when(is_float(text), F.regexp_replace(F.trim(text), "_", "").try_cast("double"))


def to_int(text: Column) -> Column:
    return F.when(is_int(text), F.regexp_replace(F.trim(text), "_", "").try_cast("int"))


def empty(text: Column) -> Column:
    """Null, or nothing but white space of any kind."""
    return ~F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r"\S"))


def parsed_odometry(rows: DataFrame, frame: str, floats: list[str], fx: str | None) -> DataFrame:
    """Rows (line_no and text cells) with `malformed`, `frame_id` and `fx_value`; blank rows go.

    A row is malformed if its frame is no integer of 32 bits, one of `floats` no number,
    or its fx neither blank nor a number; absent cells count as malformed.
    """
    cells = [frame, *floats, *([fx] if fx else [])]
    blank = F.lit(True)
    for c in cells:
        blank = blank & empty(F.col(c))
    good = is_int(F.col(frame)) & to_int(F.col(frame)).isNotNull()
    for c in floats:
        good = good & is_float(F.col(c))
    has_fx = ~empty(F.col(fx)) if fx else F.lit(False)
    if fx:
        good = good & (~has_fx | is_float(F.col(fx)))
    out = rows.filter(~blank).withColumn("malformed", ~good)
    return out.select("*", F.when(good, to_int(F.col(frame))).alias("frame_id"), (F.when(good & has_fx, to_double(F.col(fx))) if fx else F.lit(None).cast("double")).alias("fx_value"))


def odometry_summary(parsed: DataFrame) -> DataFrame:
    """One row: malformed count and first lines, pose count, and the range of fx over good rows."""
    lines = F.slice(F.array_sort(F.collect_list(F.when(F.col("malformed") & (F.col("line_no") <= F.col("_cut")), F.col("line_no")))), 1, SHOWN)
    # only the first lines are gathered
    bad = parsed.filter("malformed").orderBy("line_no").limit(SHOWN).agg(F.max("line_no").alias("_cut"))
    cut = bad.first()["_cut"]
    return parsed.withColumn("_cut", F.lit(cut).cast("bigint")).agg(F.count_if("malformed").alias("malformed"), lines.alias("first_lines"), F.count_if(~F.col("malformed")).alias("pose_count"), F.min("fx_value").alias("fx_min"), F.max("fx_value").alias("fx_max"))


def duplicates(ids: DataFrame, column: str = "frame_id") -> DataFrame:
    return ids.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def last_poses(parsed: DataFrame, columns: list[str]) -> DataFrame:
    """The last row of each frame id, by line number; a maximum over a packed row, so it aggregates before the shuffle."""
    return parsed.filter(F.col("frame_id").isNotNull()).groupBy("frame_id").agg(*[F.max_by(c, "line_no").alias(c) for c in columns])
