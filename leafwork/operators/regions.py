"""Regions of pages: underlines, dividers, boxes, running heads, line classes, blocks, captions, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import BULLET, CAPTION, ORDERED, RUNNING_HEAD, box_role, has_text, inside, overlap, trimmed
from ..functions.folds import islands
from .scale import LIMITS, RATIOS
from .segments import closed_rects, with_orientation

TEXT_TYPES = ("PARAGRAPH", "HEADING", "LIST")


def underlines(segments: DataFrame, items: DataFrame, keys: list[str], tol: Column | None = None) -> DataFrame:
    """Horizontal segments that underline an item: keys, seq, idx. The first item by idx that the segment fits takes it."""
    h = with_orientation(segments).where("orient = 'H'").select(*keys, "seq", ((F.col("y1") + F.col("y2")) / 2).alias("hy"), F.least("x1", "x2").alias("hl"), F.greatest("x1", "x2").alias("hr"))
    drop = F.col("hy") - F.col("vy")
    near = (drop >= -1) & (drop <= (tol if tol is not None else F.col("v_font") * RATIOS["r_underline"]))
    along = (F.col("vx") <= F.col("hr") + 2) & (F.col("vx") + F.col("v_width") >= F.col("hl") - 2) & (F.col("hr") - F.col("hl") < F.col("v_width") * 1.2)
    return h.join(items.where(has_text(F.col("str"))), keys).where(near & along).groupBy(*keys, "seq").agg(F.min("idx").alias("idx"))


def dividers(segments: DataFrame, items: DataFrame, regions: DataFrame | None, keys: list[str], width: Column, s: Column, underlined: DataFrame | None = None) -> DataFrame:
    """Horizontal rules of 15 % of the page width at least, in no region (widened by 5) and with no text near: keys, seq, x, y, w, h."""
    h = with_orientation(segments).where("orient = 'H'").withColumn("_mx", (F.col("x1") + F.col("x2")) / 2).withColumn("_my", (F.col("y1") + F.col("y2")) / 2)
    h = h.withColumn("_len", F.abs(F.col("x2") - F.col("x1"))).withColumn("_s", s).where(F.col("_len") >= width * 0.15)
    if underlined is not None:
        h = h.join(underlined, [*keys, "seq"], "left_anti")
    if regions is not None:
        box = regions.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_b{c}") for c in "xywh"])
        h = h.join(box, _same(keys) & inside(F.col("_mx"), F.col("_my"), *[F.col(f"_b{c}") for c in "xywh"], 5.0), "left_anti")
    text = items.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("vx").alias("_vx"), F.col("vy").alias("_vy"), F.col("v_width").alias("_vw"))
    near = (F.abs(F.col("_vy") - F.col("_my")) < F.col("_s") * 0.8) & (F.col("_vx") < F.greatest("x1", "x2") + 4) & (F.col("_vx") + F.col("_vw") > F.least("x1", "x2") - 4)
    h = h.join(text, _same(keys) & near, "left_anti")
    return h.select(*keys, "seq", F.least("x1", "x2").alias("x"), (F.col("_my") - 1).alias("y"), F.col("_len").alias("w"), F.lit(2.0).alias("h"))


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(k) == F.col(f"_{k}"))
    return out


def boxes(segments: DataFrame, items: DataFrame, keys: list[str], width: Column, table_pad: Column, eps: float, taken: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Framed boxes around text: keys, seq (of the top edge), x, y, w, h, idxs, role.

    Candidates are closed rectangles 20 high at least that are not the page's frame. By (top edge, bottom edge), the first one of
    a top edge whose yet unclaimed items include one of a quarter of its width claims them; that is a fold over the page's candidates.
    width is a column of pages (keys, ...) if these are given.
    """
    rects = closed_rects(segments, keys, eps, 20.0)
    if pages is not None:
        rects = rects.join(pages, keys)
    rects = rects.withColumn("w", F.col("x2") - F.col("x1")).withColumn("h", F.col("y2") - F.col("y1")).withColumn("_width", width)
    frame = ((F.col("x1") < F.col("_width") * 0.04) & (F.col("w") > F.col("_width") * 0.65)) | (F.col("w") > F.col("_width") * 0.88)
    rects = rects.where(~frame).select(*keys, "seq", "seq_2", F.col("x1").alias("x"), F.col("y1").alias("y"), "w", "h")
    text = items.where(has_text(F.col("str"))).withColumn("_pad", table_pad)
    if taken is not None:
        text = text.join(taken, [*keys, "idx"], "left_anti")
    hit = rects.join(text, keys).where(inside(F.col("vx"), F.col("vy"), F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("_pad")))
    cand = hit.groupBy(*keys, "seq", "seq_2", "x", "y", "w", "h").agg(F.array_sort(F.collect_list(F.struct("idx", "v_width", "str"))).alias("items"))
    pages = cand.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "seq_2", "x", "y", "w", "h", "items"))).alias("a"))
    kind = "array<struct<seq:bigint,x:double,y:double,w:double,h:double,items:array<struct<idx:bigint,v_width:double,str:string>>>>"
    start = F.struct(F.lit(-1).cast("long").alias("done"), F.array().cast("array<bigint>").alias("claimed"), F.array().cast(kind).alias("out"))

    def step(acc: Column, c: Column) -> Column:
        free = F.filter(c["items"], lambda i: ~F.array_contains(acc["claimed"], i["idx"]))
        fits = (c["seq"] != acc["done"]) & F.coalesce(F.array_max(F.transform(free, lambda i: i["v_width"])) >= c["w"] * 0.25, F.lit(False))
        box = F.struct(c["seq"].cast("long").alias("seq"), c["x"].alias("x"), c["y"].alias("y"), c["w"].alias("w"), c["h"].alias("h"), free.alias("items"))
        return F.struct(
            F.when(fits, c["seq"].cast("long")).otherwise(acc["done"]).alias("done"),
            F.when(fits, F.concat(acc["claimed"], F.transform(free, lambda i: i["idx"]))).otherwise(acc["claimed"]).alias("claimed"),
            F.when(fits, F.concat(acc["out"], F.array(box))).otherwise(acc["out"]).alias("out"),
        )

    out = pages.select(*keys, F.explode(F.aggregate("a", start, step, lambda acc: acc["out"])).alias("b")).select(*keys, "b.*")
    sample = F.substring(F.upper(F.array_join(F.transform(F.slice("items", 1, 8), lambda i: i["str"]), " ")), 1, 60)
    return out.select(*keys, "seq", "x", "y", "w", "h", F.transform("items", lambda i: i["idx"]).alias("idxs"), box_role(sample).alias("role"))


def first_fill(found: DataFrame, fills: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes with fill_color of the first filled rectangle (by seq) that overlaps them."""
    f = fills.select(*keys, F.col("seq").alias("_fs"), *[F.col(c).alias(f"_f{c}") for c in "xywh"], F.col("fill_color").alias("_fc"))
    meets = overlap(*[F.col(c) for c in "xywh"], *[F.col(f"_f{c}") for c in "xywh"]) > 0
    first = found.join(f, keys).where(meets).groupBy(*keys, "seq").agg(F.min_by("_fc", "_fs").alias("fill_color"))
    return found.join(first, [*keys, "seq"], "left")


def line_class(text: Column, font: Column, n_items: Column, body: Column, heading_scale: float = LIMITS["heading_scale"]) -> Column:
    """HEADING, LIST or PARAGRAPH of a line by its joined text and mean font size; null without text."""
    plain = trimmed(text)
    large = (font > body * heading_scale) & ~((n_items == 1) & (F.char_length(plain) <= 2))
    listed = plain.rlike(BULLET) | plain.rlike(ORDERED)
    return F.when(plain == "", F.lit(None).cast("string")).when(large, "HEADING").when(listed, "LIST").otherwise("PARAGRAPH")


def lines(banded: DataFrame, keys: list[str]) -> DataFrame:
    """One row a band: text (items by vx, trimmed and joined), font, n_items, y, and its box. Needs band; order is by (vx, idx)."""
    ordered = F.array_sort(F.collect_list(F.struct("vx", "idx", trimmed(F.col("str")).alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda i: i["t"]), " ")
    return banded.groupBy(*keys, "band").agg(
        joined.alias("text"), F.avg("v_font").alias("font"), F.count("*").alias("n_items"), F.min("vy").alias("y"),
        F.min("vx").alias("x_min"), F.max(F.col("vx") + F.col("v_width")).alias("x_max"), F.max("vy").alias("y_max"),
    )


def blocks(classed: DataFrame, keys: list[str], para_gap: Column, order: str = "y") -> DataFrame:
    """Runs of lines of one type with no vertical gap over para_gap: keys, block, type, n_lines, box and mean font.

    The gap is to the line before, whether or not that one has text; lines without a type are dropped after that.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    gapped = classed.withColumn("_gap", F.col(order) - F.lag(order).over(w)).withColumn("_para", para_gap)
    typed = gapped.where("type is not null")
    opens = F.coalesce((F.col("type") != F.lag("type").over(w)) | (F.col("_gap") > F.col("_para")), F.lit(True))
    run = islands(typed, keys, [order], opens, "block")
    return run.groupBy(*keys, "block", "type").agg(
        F.count("*").alias("n_lines"), F.sum("n_items").alias("n_items"), F.min("x_min").alias("x"), F.min("y").alias("y"), (F.max("x_max") - F.min("x_min")).alias("w"),
        (F.max("y_max") - F.min("y") + F.sum(F.col("font") * F.col("n_items")) / F.sum("n_items")).alias("h"), (F.sum(F.col("font") * F.col("n_items")) / F.sum("n_items")).alias("font_size"),
    )


def running_heads(found: DataFrame, height: Column, s: Column, bands: Column | None = None) -> DataFrame:
    """Text regions in the top or bottom 12 % of the page become HEADER or FOOTER: by small font, a running-head pattern, or a coloured band.

    Needs type, y_center, font_size and text; fewer than two visible characters are enough only for a pattern.
    """
    top, low = F.col("y_center") < height * 0.12, F.col("y_center") > height * 0.88
    pattern = F.col("text").rlike(RUNNING_HEAD)
    visible = F.char_length(F.regexp_replace("text", r"\s", "")) >= 2
    signs = (F.col("font_size") < s * 0.85) | pattern | (bands if bands is not None else F.lit(False))
    turned = F.col("type").isin(*TEXT_TYPES) & (top | low) & (visible | pattern) & signs
    return found.withColumn("type", F.when(turned, F.when(top, "HEADER").otherwise("FOOTER")).otherwise(F.col("type")))


def captions(found: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Images with the paragraph right after them as caption: keys, image, caption.

    It starts -10 to 45 below the image, and names a figure, or is short and centred under it.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = {f"n_{c}": F.lead(c).over(w) for c in ("id", "type", "x", "y", "w", "text")}
    r = found.withColumns(ahead).where("type = 'IMAGE' and n_type = 'PARAGRAPH'")
    gap = F.col("n_y") - (F.col("y") + F.col("h"))
    centred = (F.char_length("n_text") < 150) & (F.abs((F.col("n_x") + F.col("n_w") / 2) - (F.col("x") + F.col("w") / 2)) < 30)
    return r.where((gap >= -10) & (gap <= 45) & (F.col("n_text").rlike(CAPTION) | centred)).select(*keys, F.col("id").alias("image"), F.col("n_id").alias("caption"))


def without_covered(found: DataFrame, others: DataFrame, keys: list[str], share: float, at_least: bool = True) -> DataFrame:
    """Regions (x, y, w, h) of which no single other region covers share of the area (more than share, if not at_least)."""
    o = others.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_o{c}") for c in "xywh"])
    area = F.col("w") * F.col("h")
    part = F.when(area > 0, overlap(*[F.col(c) for c in "xywh"], *[F.col(f"_o{c}") for c in "xywh"]) / area).otherwise(0.0)
    return found.join(o, _same(keys) & (part >= share if at_least else part > share), "left_anti")


def region_counts(found: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """Regions by type: n, and visible with a confidence (1 where null) of least."""
    return found.groupBy(*keys, "type").agg(F.count("*").alias("n"), F.count_if(F.coalesce("confidence", F.lit(1.0)) >= least).alias("visible"))
