"""Arrangement of a page: sources of column splits, items across them, table edges, and what people drag, nudge, fold and toggle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chosen_splits(sources: DataFrame, keys: list[str]) -> DataFrame:
    """The splits of the first source, by priority, that has any on a page: keys, priority, split."""
    first = sources.groupBy(*keys).agg(F.min("priority").alias("priority"))
    return sources.join(first, [*keys, "priority"]).select(*keys, "priority", "split")


def full_width(items: DataFrame, splits: DataFrame, keys: list[str], tol: Column | float = 5.0) -> DataFrame:
    """Items that reach across a split and fit into no column that is wider by tol on both sides."""
    tol = tol if isinstance(tol, Column) else F.lit(tol)
    listed = splits.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("split").cast("double"))).alias("_at"))
    left, right = F.col("vx"), F.col("vx") + F.coalesce("v_width", F.lit(0.0))
    across = F.exists("_at", lambda s: (left < s) & (right > s))
    ends = lambda sign: F.array(F.lit(sign * float("inf")))
    fits = F.zip_with(F.concat(ends(-1), "_at"), F.concat("_at", ends(1)), lambda lo, hi: (left >= lo - tol) & (right <= hi + tol))
    return items.join(listed, keys).where(across & ~F.exists(fits, lambda f: f)).drop("_at")


def table_edges(gutters: DataFrame, slats: DataFrame, keys: list[str], order: str, tol: Column) -> DataFrame:
    """keys, n, x: the gutters in their order, then each slat (a vertical line) that is tol or more from all edges so far.

    Whether a slat counts depends on those before it, so this is a fold over the slats of one table.
    """
    packed = lambda df, name: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "x"))), lambda s: s["x"].cast("double")).alias(name))
    both = packed(gutters, "_g").join(packed(slats, "_s"), keys, "full")
    none = F.array().cast("array<double>")
    edges = F.aggregate(F.array_distinct(F.coalesce("_s", none)), F.coalesce("_g", none), lambda seen, s: F.when(F.exists(seen, lambda g: F.abs(g - s) < tol), seen).otherwise(F.concat(seen, F.array(s))))
    return both.select(*keys, F.posexplode(edges).alias("n", "x")).withColumn("n", F.col("n").cast("long"))


def dragged(widths: Column, at: Column, delta: Column, least: float = 40.0) -> Column:
    """Widths of columns after the divider behind column at (from 0) moved by delta; neither neighbour gets below least."""
    low = F.lit(least)
    return F.transform(widths, lambda w, i: F.when(i == at, F.greatest(low, w + delta)).when(i == at + 1, F.greatest(low, w - delta)).otherwise(w))


def one_more_column(cols: Column, most: int = 4) -> Column:
    """Columns of a zone after a drop at its side; none is added to most."""
    return F.when(cols < most, cols + 1).otherwise(cols)


def nudged(tx: Column, ty: Column, key: Column, shift: Column) -> Column:
    """struct(tx, ty) after an arrow key: four pixels, or one with shift. Other keys move nothing."""
    step = F.when(shift, 1).otherwise(4)
    moved = lambda at, less, more: (F.coalesce(at, F.lit(0)) + F.when(key == less, -step).when(key == more, step).otherwise(0)).cast("long")
    return F.struct(moved(tx, "ArrowLeft", "ArrowRight").alias("tx"), moved(ty, "ArrowUp", "ArrowDown").alias("ty"))


def placement_style(pad: Column, tx: Column, ty: Column) -> Column:
    """Style text of a region's padding and shift; what is null is left out, one shift alone has 0 beside it."""
    padding = F.when(pad.isNotNull(), F.concat(F.lit("padding: "), pad.cast("string"), F.lit("px")))
    px = lambda c: F.concat(F.coalesce(c.cast("string"), F.lit("0")), F.lit("px"))
    shift = F.when(tx.isNotNull() | ty.isNotNull(), F.concat(F.lit("transform: translate("), px(tx), F.lit(","), px(ty), F.lit(")")))
    return F.concat_ws("; ", padding, shift)


def folded_rows(rows: DataFrame, keys: list[str], order: str, header: Column, clicked: Column) -> DataFrame:
    """rows with hidden: those from a clicked header, itself excepted, to the next header."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    folded = F.last(F.when(header, clicked), ignorenulls=True).over(before)
    return rows.withColumn("hidden", ~header & F.coalesce(folded, F.lit(False)))


def active_cells(classes: Column, active: Column, value: Column) -> Column:
    """Whether a cell is active once an option is chosen: of those that belong to options, the value's; others stay as they are."""
    optional = F.exists(classes, lambda c: c.contains("sp-"))
    return F.when(optional, F.array_contains(classes, F.concat(F.lit("sp-"), value))).otherwise(active)


def requests(layers: DataFrame, customs: DataFrame, splits: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each page to extract again: keys, skip (types whose layer is off), customs (ids), splits, each sorted; pages with none of these are none."""
    off = layers.where("not on").groupBy(*keys).agg(F.array_sort(F.collect_set("type")).alias("skip"))
    own = customs.groupBy(*keys).agg(F.array_sort(F.collect_set("id")).alias("customs"))
    cuts = splits.groupBy(*keys).agg(F.array_sort(F.collect_set("split")).alias("splits"))
    out = off.join(own, keys, "full").join(cuts, keys, "full")
    return out.select(*keys, *[F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("skip", "customs", "splits")])


def threshold_px(s: Column, ratio: float, zoom: float = 1.0) -> Column:
    """A threshold in displayed pixels: a ratio of the page's scale."""
    return s * ratio * zoom


def passes(confidence: Column, least: float) -> Column:
    """Whether a table's confidence (none: 0) reaches the threshold."""
    return F.coalesce(confidence, F.lit(0.0)) >= least


def can_drop(dragged: Column, target: Column) -> Column:
    """Whether what is dragged may be dropped there: zones on zones, regions on regions and columns."""
    return ((dragged == "zone") & (target == "zone")) | ((dragged == "region") & target.isin("region", "column"))


def drop_side(at: Column, width: Column, cols: Column) -> Column:
    """left or right for a drop in the outer quarter of a region (at: from its left edge), which makes a zone of two columns there; null elsewhere and where columns are already."""
    return F.when(cols == 1, F.when(at < width * 0.25, "left").when(at > width * 0.75, "right"))


def reordered(rows: DataFrame, moves: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """rows with order counted anew from 0, the moved one of each page before or after its target. moves: keys, moved, target, after; one a page at most. A missing target moves nothing."""
    places = rows.select(*keys, F.col(name).alias("target"), F.col(order).alias("_t"))
    known = moves.join(places, [*keys, "target"]).select(*keys, "moved", "after", "_t")
    at = F.when(F.col(name) == F.col("moved"), F.col("_t") + F.when(F.col("after"), 0.5).otherwise(-0.5)).otherwise(F.col(order))
    out = rows.join(known, keys, "left").withColumn("_at", at)
    return out.withColumn(order, (F.row_number().over(Window.partitionBy(*keys).orderBy("_at", name)) - 1).cast("long")).select(*rows.columns)
