"""Text of pages: lines with spaces where gaps are, style runs, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import BOLD_NAMES, ITALIC_NAMES, escape, has_text, or_default, plain_font, trimmed
from ..functions.folds import islands, sorted_groups


def text_bands(items: DataFrame, keys: list[str], fraction: float = 0.45) -> DataFrame:
    """Items (x, y upwards, width, size, str) with line, from the top: a running mean takes items within fraction of the mean size."""
    size = F.avg(F.abs(or_default(F.col("size"), 12.0))).over(Window.partitionBy(*keys))
    some = items.where(has_text(F.col("str"))).withColumn("body", size)
    return sorted_groups(some, keys, -F.col("y"), ["idx"], F.col("body") * fraction, "running", "line")


def with_gaps(banded: DataFrame, keys: list[str], fraction: float = 0.25) -> DataFrame:
    """Items with lead, the blank (or nothing) that stands before them in their line.

    A blank goes where the gap to the item before is over fraction of that one's mean character width and neither side brings its own white space.
    """
    w = Window.partitionBy(*keys, "line").orderBy("x", "idx")
    before, end = F.lag("str").over(w), F.lag(F.col("x") + F.coalesce("width", F.lit(0.0))).over(w)
    char = F.when(F.char_length(before) > 0, F.lag(F.coalesce("width", F.lit(0.0))).over(w) / F.char_length(before)).otherwise(F.abs(or_default(F.lag("size").over(w), 6.0)) * 0.5)
    spaced = before.isNotNull() & ~before.rlike(r"\s$") & ~F.col("str").rlike(r"^\s") & (F.col("x") - end > char * fraction)
    return banded.withColumn("lead", F.when(spaced, " ").otherwise(""))


def line_text(banded: DataFrame, keys: list[str]) -> DataFrame:
    """One row a line: text, y (the running mean), n_items, font, and whether an item ends its line (has_eol, where given)."""
    gapped = with_gaps(banded, keys)
    ordered = F.array_sort(F.collect_list(F.struct("x", "idx", F.concat("lead", "str").alias("t"))))
    # the fold's own order gives the running mean of y again
    by_y = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("v"), "idx")))
    mean = F.aggregate(by_y, F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("n")), lambda a, s: F.struct(((a["m"] * a["n"] + s["v"]) / (a["n"] + 1)).alias("m"), (a["n"] + 1).alias("n")), lambda a: -a["m"])
    eol = F.max("has_eol") if "has_eol" in banded.columns else F.lit(False)
    return gapped.groupBy(*keys, "line").agg(F.array_join(F.transform(ordered, lambda i: i["t"]), "").alias("text"), mean.alias("y"), F.count("*").alias("n_items"), F.avg(F.abs(or_default(F.col("size"), 12.0))).alias("font"), eol.alias("has_eol"), F.max("body").alias("body"))


def paragraphs(lined: DataFrame, keys: list[str], multiple: float = 1.5) -> DataFrame:
    """Lines joined into paragraphs: keys, paragraph, text, n_lines, font.

    A break stands where the gap to the line before is over multiple of the mean gap (gaps of three body sizes or more don't count;
    without any, 1.2 body sizes), or where that line ends by itself.
    """
    w = Window.partitionBy(*keys).orderBy("line")
    gapped = lined.withColumn("gap", F.abs(F.lag("y").over(w) - F.col("y"))).withColumn("_eol", F.lag("has_eol").over(w))
    usual = F.coalesce(F.avg(F.when(F.col("gap") < F.col("body") * 3, F.col("gap"))).over(Window.partitionBy(*keys)), F.col("body") * 1.2)
    opens = F.col("gap").isNull() | (F.col("gap") > F.col("_usual") * multiple) | F.col("_eol")
    run = islands(gapped.withColumn("_usual", usual), keys, ["line"], opens, "paragraph")
    ordered = F.array_sort(F.collect_list(F.struct("line", trimmed(F.col("text")).alias("t"))))
    return run.groupBy(*keys, "paragraph").agg(F.array_join(F.transform(ordered, lambda i: i["t"]), " ").alias("text"), F.count("*").alias("n_lines"), F.max("font").alias("font"), F.max("body").alias("body"))


def page_text(paras: DataFrame, keys: list[str], form: str = "text", heading_scale: float = 1.25) -> DataFrame:
    """keys, text: the paragraphs of a page, as plain text or as html (single large lines become h3 or h4)."""
    safe = escape(F.col("text"))
    head = (F.col("n_lines") == 1) & (F.col("font") > F.col("body") * heading_scale)
    tag = F.when(head & (F.col("font") > F.col("body") * 1.6), "h3").when(head, "h4").otherwise("p")
    one = F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">")) if form == "html" else F.col("text")
    ordered = F.array_sort(F.collect_list(F.struct("paragraph", one.alias("t"))))
    return paras.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda i: i["t"]), "\n" if form == "html" else "\n\n").alias("text"))


def column_lines(banded: DataFrame, splits: DataFrame, keys: list[str]) -> DataFrame:
    """Items by column of their page's splits; one within a point left of a split stands in both columns. Adds column."""
    edges = splits.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("_s"))
    out = banded.join(edges, keys, "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<double>")))
    bounds = F.concat(F.array(F.lit(0.0)), "_s", F.array(F.lit(float("inf"))))
    each = out.withColumn("_b", bounds).withColumn("column", F.explode(F.sequence(F.lit(0), F.size("_s"))))
    inside = (F.col("x") >= F.element_at("_b", F.col("column") + 1) - 1) & (F.col("x") < F.element_at("_b", F.col("column") + 2))
    return each.where(inside).drop("_s", "_b")


def style_runs(items: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring items of one style as one run with nested tags: keys, line, run, html. A gap's blank has the style of the item after it."""
    plain = plain_font(F.col("font_name"))
    flag = lambda c, other: F.coalesce(F.col(c), other) if c in items.columns else other
    styled = with_gaps(items, keys).withColumns({"_b": flag("bold", plain.rlike(BOLD_NAMES)), "_i": flag("italic", plain.rlike(ITALIC_NAMES)), "_u": flag("underlined", F.lit(False))})
    w = Window.partitionBy(*keys, "line").orderBy("x", "idx")
    style = F.struct("_b", "_i", "_u")
    run = islands(styled.withColumn("_st", style), [*keys, "line"], ["x", "idx"], F.coalesce(F.col("_st") != F.lag("_st").over(w), F.lit(True)), "run")
    ordered = F.array_sort(F.collect_list(F.struct("x", "idx", F.concat("lead", "str").alias("t"))))
    joined = run.groupBy(*keys, "line", "run", "_b", "_i", "_u").agg(escape(F.array_join(F.transform(ordered, lambda i: i["t"]), "")).alias("html"))
    html = F.col("html")
    for c, tag in (("_u", "u"), ("_i", "em"), ("_b", "strong")):
        html = F.when(F.col(c), F.concat(F.lit(f"<{tag}>"), html, F.lit(f"</{tag}>"))).otherwise(html)
    return joined.select(*keys, "line", "run", html.alias("html"))


def list_entry(text: Column) -> Column:
    """struct(ordered, number, text) of a list line without its marker."""
    plain = trimmed(text)
    ordered = plain.rlike(r"^(?:\d{1,3}|[a-zA-Z]|[ivxIVX]+)[.)]\s")
    body = F.regexp_replace(F.regexp_replace(plain, r"^(?:\d{1,3}|[a-zA-Z]|[ivxIVX]+)[.)]\s+", ""), r"^[•‣◦▪▫–—―·○◉-]\s+", "")
    return F.struct(ordered.alias("ordered"), F.regexp_extract(plain, r"^(\d{1,3})[.)]\s", 1).try_cast("int").alias("number"), body.alias("text"))
