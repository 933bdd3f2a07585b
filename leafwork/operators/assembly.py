"""From detected parts to pages: usable lines, column rules, columns and layout of regions, tables of structure trees, labels and styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up, has_text, inside
from .regions import _same

#: Roles of structure nodes that belong to tables.
TABLE_ROLES = ("Table", "TR", "THead", "TBody", "TFoot", "TD", "TH")


def usable_lines(segments: DataFrame, height: Column | float, eps: float = 4.0, least: float = 12.0) -> DataFrame:
    """Segments that can be lines of a table, with kind (H or V): axis-aligned, of least length; a V of over three page heights is none (height 0: no such limit)."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    tall = height if isinstance(height, Column) else F.lit(height)
    kind = F.when((dy <= eps) & (dx > eps), "H").when((dx <= eps) & (dy > eps) & ~((tall > 0) & (dy > tall * 3)), "V")
    return segments.withColumn("kind", kind).where((F.sqrt(dx * dx + dy * dy) >= least) & F.col("kind").isNotNull())


def content_extent(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, top, bottom: from the highest top to the lowest baseline of the items with text."""
    return items.where(has_text(F.col("str"))).groupBy(*keys).agg(F.min(F.col("vy") - F.col("v_font")).alias("top"), F.max("vy").alias("bottom"))


def column_rules(segments: DataFrame, items: DataFrame, keys: list[str], width: Column) -> DataFrame:
    """Vertical lines that part columns: 60 % of the content's height at least, their middle between 10 % and 90 % of the page's width."""
    middle = (F.col("x1") + F.col("x2")) / 2
    tall = F.abs(F.col("y2") - F.col("y1")) >= (F.col("bottom") - F.col("top")) * 0.60
    lines = usable_lines(segments, 0.0).where("kind = 'V'")
    return lines.join(content_extent(items, keys).where("bottom > top"), keys).where(tall & middle.between(width * 0.10, width * 0.90)).drop("top", "bottom")


def region_columns(found: DataFrame, splits: DataFrame, keys: list[str], width: Column, slack: float = 5.0) -> DataFrame:
    """found with column, where it is -1, set to the column that the region's centre is in; regions of 65 % of the width, or across a split, stay. splits: keys, split."""
    listed = splits.groupBy(*keys).agg(F.collect_set("split").alias("_splits"))
    left, right = F.col("x"), F.col("x") + F.col("w")
    across = F.exists("_splits", lambda s: (left < s - slack) & (right > s + slack))
    centre = F.size(F.filter("_splits", lambda s: s <= left + F.col("w") / 2))
    moves = (F.col("column") == -1) & F.col("_splits").isNotNull() & (F.col("w") < width * 0.65) & ~across
    return found.join(listed, keys, "left").withColumn("column", F.when(moves, centre).otherwise(F.col("column")).cast("long")).drop("_splits")


def layout_class(found: DataFrame, keys: list[str], order: str, n_columns: Column, width: Column, near: float = 15.0) -> DataFrame:
    """Layout of each zone (keys): layout-card-grid with three headings at one height, layout-feature with two columns, the left one of headings and images and the right one with text, else layout-equal.

    Heights are grouped in the regions' order: a heading joins the first group whose running mean is nearer than near. Groups are few, as a page's height bounds them.
    """
    heads = F.transform(F.filter(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "type", "y_center"))), lambda r: r["type"] == "HEADING"), lambda r: r["y_center"].cast("double"))
    group = lambda y, n: F.struct(y.alias("y"), n.cast("long").alias("n"))

    def step(groups: Column, y: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: F.abs(g["y"] - y) < near), True)
        joined = F.transform(groups, lambda g, i: F.when(i == at - 1, group((g["y"] * g["n"] + y) / (g["n"] + 1), g["n"] + 1)).otherwise(g))
        return F.when(at > 0, joined).otherwise(F.concat(groups, F.array(group(y, F.lit(1)))))

    left = (F.col("column") == 0) | (F.col("x") < width / 2)
    right = (F.col("column") == 1) | (F.col("x") >= width / 2)
    visual, words = F.col("type").isin("HEADING", "IMAGE"), F.col("type").isin("PARAGRAPH", "LIST")
    feature = F.coalesce(F.bool_and(F.when(left, visual)), F.lit(False)) & F.bool_or(right & words) & (F.max(n_columns) == 2)
    zones = found.groupBy(*keys).agg(heads.alias("_heads"), feature.alias("_feature"))
    grid = F.exists(F.aggregate("_heads", F.array().cast("array<struct<y:double,n:bigint>>"), step), lambda g: g["n"] >= 3)
    return zones.select(*keys, F.when(grid, "layout-card-grid").when(F.col("_feature"), "layout-feature").otherwise("layout-equal").alias("layout"))


def has_table_roles(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys of the structure trees with a node of a table."""
    return nodes.where(F.col("role").isin(*TABLE_ROLES)).select(*keys).distinct()


def struct_tables(cells: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Regions of tables of structure trees: keys, table_id, x, y, w, h, n_cells, around the cells' items with text. cells: table_id, r, c, idxs. Tables without text are none."""
    each = cells.select(*keys, "table_id", "r", "c", F.explode("idxs").alias("idx"))
    box = each.join(items.where(has_text(F.col("str"))), [*keys, "idx"]).groupBy(*keys, "table_id").agg(F.min("vx").alias("x"), F.min(F.col("vy") - F.col("v_font")).alias("y"), F.max(F.col("vx") + F.col("v_width")).alias("_r"), F.max("vy").alias("_b"))
    counted = cells.groupBy(*keys, "table_id").agg(F.count("*").alias("n_cells"))
    return box.join(counted, [*keys, "table_id"]).select(*keys, "table_id", "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"), "n_cells")


def struct_replaced(found: DataFrame, tables: DataFrame, keys: list[str], slack: float = 10.0) -> DataFrame:
    """found without the regions that a table of the structure tree holds (by their vertical centre, and by x within slack), and with these tables. Both have keys, id, x, y, w, h."""
    t = tables.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_t{c}") for c in "xywh"])
    centre = F.col("y") + F.col("h") / 2
    held = centre.between(F.col("_ty"), F.col("_ty") + F.col("_th")) & (F.col("x") >= F.col("_tx") - slack) & (F.col("x") + F.col("w") <= F.col("_tx") + F.col("_tw") + slack)
    return found.join(t, _same(keys) & held, "left_anti").unionByName(tables.select(*found.columns))


def narrow_grids(grids: DataFrame, items: DataFrame, keys: list[str], pad: Column, share: float = 0.30) -> DataFrame:
    """Boxes of grids with two column lines (x, y, w, h): keys, x, y, w, h, idxs, sample, where an item inside has this share of the width. Needs an item's pad."""
    hit = grids.join(items.where(has_text(F.col("str"))).withColumn("_pad", pad), keys).where(inside(F.col("vx"), F.col("vy"), *[F.col(c) for c in "xywh"], F.col("_pad")))
    ordered = F.array_sort(F.collect_list(F.struct("vy", "vx", "idx", "str")))
    found = hit.groupBy(*keys, "x", "y", "w", "h").agg(ordered.alias("_items"), F.max("v_width").alias("_widest")).where(F.col("_widest") >= F.col("w") * share)
    sample = F.upper(F.substring(F.trim(F.array_join(F.transform(F.slice("_items", 1, 8), lambda i: i["str"]), " ")), 1, 60))
    return found.select(*keys, "x", "y", "w", "h", F.transform("_items", lambda i: i["idx"]).alias("idxs"), sample.alias("sample"))


def fill_style(fill: Column) -> Column:
    """Background of a region's fill (array of shares): empty for none, for near-white and for near-black, which is the default that no one set."""
    neutral = fill.isNull() | F.forall(fill, lambda c: c > 0.92) | F.forall(fill, lambda c: c < 0.08)
    shares = F.array_join(F.transform(fill, lambda c: half_up(c * 255).cast("long").cast("string")), ",")
    return F.when(neutral, "").otherwise(F.concat(F.lit("background:rgb("), shares, F.lit(")")))


def crop_size(pixels: Column) -> Column:
    """Displayed length of an image cut out at four times the scale."""
    return half_up(pixels / 4).cast("long")


def placeholder_style(w: Column, h: Column, width: Column) -> Column:
    """Room for an image that was not cut out: its share of the page's width, and its shape."""
    share = F.when(width > 0, F.least(F.lit(100), half_up(w / width * 100).cast("long"))).otherwise(100)
    shape = F.when((w > 0) & (h > 0), F.concat(F.lit("aspect-ratio: "), half_up(w).cast("long"), F.lit(" / "), half_up(h).cast("long"), F.lit("; height: auto;"))).otherwise("min-height: 120px;")
    return F.concat(F.lit("width: "), share, F.lit("%; "), shape)


def page_labels(pages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """pages with label: the place of each page among those of its document."""
    of = Window.partitionBy(*keys)
    return pages.withColumn("label", F.concat_ws(" ", F.lit("Page"), F.row_number().over(of.orderBy(order)), F.lit("of"), F.count("*").over(of)))


def most_visible(pages: DataFrame, keys: list[str], order: str, top: Column, bottom: Column) -> DataFrame:
    """Of the pages of each document (y, h) the one that shows most between top and bottom, the first one of equals; none where nothing shows."""
    shown = F.least(F.col("y") + F.col("h"), bottom) - F.greatest(F.col("y"), top)
    return pages.withColumn("_shown", shown).where("_shown > 0").groupBy(*keys).agg(F.max_by(order, F.struct("_shown", (-F.col(order)).alias("o"))).alias(order))
