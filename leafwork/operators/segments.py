"""Path segments: orientation, thin rectangles, dash runs, collinear runs, closed rectangles, curve boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up, hex_color, orientation
from ..functions.folds import islands, merged_intervals, sorted_groups

ENDS = ("x1", "y1", "x2", "y2")


def with_orientation(segments: DataFrame, eps: float = 4.0) -> DataFrame:
    return segments.withColumn("orient", orientation(*[F.col(c) for c in ENDS], eps))


def orientation_counts(segments: DataFrame, keys: list[str], eps: float = 4.0) -> DataFrame:
    """n_total, n_h, n_v, n_diag of each page; a short dot is in no class."""
    each = [F.count_if(F.col("orient") == o).alias(n) for o, n in (("H", "n_h"), ("V", "n_v"), ("diag", "n_diag"))]
    return with_orientation(segments, eps).groupBy(*keys).agg(F.count("*").alias("n_total"), *each)


def normalised(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The segment with ascending ends along its longer side."""
    flat = F.abs(y2 - y1) <= F.abs(x2 - x1)
    swap = F.when(flat, x1 > x2).otherwise(y1 > y2)
    pick = lambda a, b: F.when(swap, b).otherwise(a)
    return F.struct(pick(x1, x2).alias("x1"), pick(y1, y2).alias("y1"), pick(x2, x1).alias("x2"), pick(y2, y1).alias("y2"))


def thin_rects(rects: DataFrame, eps: float = 4.0) -> DataFrame:
    """Rectangles (x, y, w, h) as segments: one line where a side is under eps, else four edges. Adds edge, x1, y1, x2, y2."""
    x, y, r, b = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    line = lambda *p: F.struct(*[c.alias(n) for c, n in zip(p, ENDS, strict=True)])
    my, mx = (y + b) / 2, (x + r) / 2
    lines = F.when(F.col("h") < eps, F.array(line(x, my, r, my))).when(F.col("w") < eps, F.array(line(mx, y, mx, b)))
    lines = lines.otherwise(F.array(line(x, y, r, y), line(r, y, r, b), line(x, b, r, b), line(x, y, x, b)))
    out = rects.select("*", F.posexplode(lines).alias("edge", "_l")).withColumn("edge", F.col("edge").cast("long"))
    return out.select(*rects.columns, "edge", "_l.*")


def dash_runs(segments: DataFrame, keys: list[str], eps: float = 4.0) -> DataFrame:
    """Single axis-parallel segments of one colour, width class, direction and band, merged across gaps under max(8, 0.4 * mean length).

    The gap is measured to the farthest end so far; a run takes its cross coordinate from its first piece.
    """
    seg = with_orientation(segments, eps).where("orient in ('H', 'V')")
    flat = F.col("orient") == "H"
    lo = F.when(flat, F.least("x1", "x2")).otherwise(F.least("y1", "y2"))
    hi = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2"))
    across = F.when(flat, F.col("y1")).otherwise(F.col("x1"))
    middle = F.when(flat, (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2)
    color = hex_color(F.col("stroke_color")) if "stroke_color" in segments.columns else F.lit("")
    wide = half_up(F.col("stroke_width") * 2) if "stroke_width" in segments.columns else F.lit(0).cast("long")
    seg = seg.select(*keys, "seq", "orient", color.alias("color"), wide.alias("wide"), (half_up(middle / eps) * eps).alias("band"), lo.alias("lo"), hi.alias("hi"), across.alias("across"))
    part = [*keys, "color", "wide", "orient", "band"]
    limit = F.greatest(F.lit(8.0), F.lit(0.4) * F.avg(F.col("hi") - F.col("lo")).over(Window.partitionBy(*part)))
    before = Window.partitionBy(*part).orderBy("lo", "seq").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("reach", F.max("hi").over(before)).withColumn("limit", limit)
    opens = F.col("reach").isNull() | (F.col("lo") - F.col("reach") >= F.col("limit"))
    runs = islands(seg, part, ["lo", "seq"], opens, "run")
    return runs.groupBy(*part, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("across", F.struct("lo", "seq")).alias("across"), F.count("*").alias("pieces"))


def collinear(segments: DataFrame, keys: list[str], kind: str, eps: float = 5.0) -> DataFrame:
    """Long horizontal (H) or vertical (V) lines: segments grouped by cross coordinate (first member as anchor), merged where they come within 2 * eps.

    pos is the mean cross coordinate of the group.
    """
    cross, lo, hi = ("y1", "x1", "x2") if kind == "H" else ("x1", "y1", "y2")
    seg = with_orientation(segments, eps).where(F.col("orient") == kind)
    seg = seg.select(*keys, "seq", F.col(cross).alias("pos"), F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi"))
    grouped = sorted_groups(seg, keys, F.col("pos"), ["seq"], F.lit(eps), "anchor", "grp")
    mean = grouped.withColumn("pos", F.avg("pos").over(Window.partitionBy(*keys, "grp")))
    return merged_intervals(mean, [*keys, "grp", "pos"], "lo", "hi", 2 * eps)


def closed_rects(segments: DataFrame, keys: list[str], eps: float = 6.0, least_height: float = 4.0, twice: bool = False) -> DataFrame:
    """Rectangles closed by two horizontal segments of the same span and two vertical ones that cover their sides.

    Each unordered pair of horizontals counts once; with twice, once in either order.
    """
    seg = with_orientation(segments).where("orient is not null")
    h = seg.where("orient = 'H'").select(*keys, "seq", ((F.col("y1") + F.col("y2")) / 2).alias("y"), F.least("x1", "x2").alias("l"), F.greatest("x1", "x2").alias("r"))
    v = seg.where("orient = 'V'").select(*keys, ((F.col("x1") + F.col("x2")) / 2).alias("vx"), F.least("y1", "y2").alias("t"), F.greatest("y1", "y2").alias("b"))
    other = h.select(*keys, *[F.col(c).alias(f"{c}_2") for c in ("seq", "y", "l", "r")])
    order = F.col("seq") != F.col("seq_2") if twice else F.col("seq") < F.col("seq_2")
    pair = h.join(other, keys).where(order & (F.abs(F.col("l") - F.col("l_2")) <= eps) & (F.abs(F.col("r") - F.col("r_2")) <= eps) & (F.abs(F.col("y") - F.col("y_2")) >= least_height))
    pair = pair.select(*keys, "seq", "seq_2", ((F.col("l") + F.col("l_2")) / 2).alias("x1"), F.least("y", "y_2").alias("y1"), ((F.col("r") + F.col("r_2")) / 2).alias("x2"), F.greatest("y", "y_2").alias("y2"))
    for side in ("x1", "x2"):
        wall = v.select(*[F.col(k).alias(f"_{k}") for k in keys], "vx", "t", "b")
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"_{k}"))
        covers = (F.abs(F.col("vx") - F.col(side)) <= eps) & (F.col("t") <= F.col("y1") + eps) & (F.col("b") >= F.col("y2") - eps)
        pair = pair.join(wall, same & covers, "left_semi")
    return pair


def _cubic(p: list[Column]) -> Callable[[Column], Column]:
    """The cubic with these control values, as a function of t."""

    def at(t: Column) -> Column:
        u = 1 - t
        return u * u * u * p[0] + 3 * u * u * t * p[1] + 3 * u * t * t * p[2] + t * t * t * p[3]

    return at


def bezier_bounds(curves: DataFrame) -> DataFrame:
    """Cubic curves (px, py: arrays of four) with their exact boxes: x_min, x_max, y_min, y_max."""
    bounds = {}
    for axis in ("x", "y"):
        p = [F.col(f"p{axis}")[i] for i in range(4)]
        a, b, c = p[1] - p[0], p[2] - p[1], p[3] - p[2]
        # the derivative is proportional to (a - 2b + c) t^2 + 2 (b - a) t + a
        q2, q1, q0 = a - 2 * b + c, 2 * (b - a), a
        disc = q1 * q1 - 4 * q2 * q0
        bend = F.abs(q2) > 1e-6
        roots = F.when(bend & (disc >= 0), F.array((-q1 + F.sqrt(disc)) / (2 * q2), (-q1 - F.sqrt(disc)) / (2 * q2))).when(~bend & (F.abs(q1) > 1e-6), F.array(-q0 / q1)).otherwise(F.array().cast("array<double>"))
        inner = F.filter(roots, lambda t: (t > 0) & (t < 1))

        at = _cubic(p)

        values = F.concat(F.array(p[0], p[3]), F.transform(inner, at))
        bounds |= {f"{axis}_min": F.array_min(values), f"{axis}_max": F.array_max(values)}
    return curves.withColumns(bounds)
