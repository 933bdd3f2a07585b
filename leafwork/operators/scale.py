"""Page scale: the modal font size of a page and the pixel tolerances that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import apply_affine, half_up, has_text, or_default

#: Ratios of the modal font size.
RATIOS = {"r_y_band": 0.45, "r_para_gap": 1.80, "r_table_pad": 0.80, "r_underline": 0.35, "r_proximity": 0.60, "r_col_tol": 0.80, "r_stream_gap": 2.50, "r_col_gap_min": 1.50, "r_cluster_y_gap": 2.00, "r_cluster_x_gap": 1.50}
#: Thresholds of table and heading detection.
LIMITS = {"stream_confidence": 0.60, "stream_min_cols": 3, "stream_min_bands": 3, "heading_scale": 1.25, "stream_min_fill": 0.30, "stream_max_avg_len": 20, "stream_max_items_band": 8}
OVERRIDABLE = ("r_y_band", "r_para_gap", "r_col_gap_min", "stream_confidence")


def text_meta(items: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Raw items (transform, width, str, font_name) in viewport coordinates, by the viewport matrix vp of pages."""
    t, vp = F.col("transform"), F.col("vp")
    length = lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x)
    scale_x, scale_y = length(F.hypot(vp[0], vp[1])), length(F.hypot(vp[2], vp[3]))
    size = F.abs(or_default(t[3], 12.0))
    width = or_default(F.col("width"), size * 0.5 * or_default(F.char_length("str"), 1).cast("double"))
    vx, vy = apply_affine(vp, t[4], t[5])
    out = items.join(pages.select(*keys, "vp"), keys)
    return out.select(*keys, "idx", "str", vx.alias("vx"), vy.alias("vy"), (width * scale_x).alias("v_width"), (size * scale_y).alias("v_font"), size.alias("font_size"), "font_name", F.lit(False).alias("underlined"), F.lit(False).alias("bold"), (F.abs(t[2]) > 0.05).alias("italic"))


def page_scale(items: DataFrame, keys: list[str], v_scale: Column | float = 1.0, overrides: DataFrame | None = None) -> DataFrame:
    """One row a page: s, the most frequent font size in half-pixel bins (the bin seen first, on ties), and the pixel tolerances."""
    unit = v_scale if isinstance(v_scale, Column) else F.lit(v_scale)
    size = or_default(F.col("v_font"), 12 * unit)
    bins = items.where(has_text(F.col("str"))).select(*keys, "idx", (half_up(size * 2) / 2).alias("bin"))
    counted = bins.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    mode = counted.groupBy(*keys).agg(F.max_by("bin", F.struct("n", -F.col("first"))).alias("s"))
    out = items.select(*keys).distinct().join(mode, keys, "left").withColumn("s", F.coalesce("s", 12 * unit))
    for name, value in {**RATIOS, "stream_confidence": LIMITS["stream_confidence"]}.items():
        out = out.withColumn(name, F.lit(value))
    if overrides is not None:
        own = overrides.select(*keys, *[F.col(c).alias(f"_{c}") for c in OVERRIDABLE])
        out = out.join(own, keys, "left")
        for name in OVERRIDABLE:
            out = out.withColumn(name, F.coalesce(f"_{name}", name)).drop(f"_{name}")
    s = F.col("s")
    named = {"y_band_tol": "r_y_band", "para_gap": "r_para_gap", "proximity": "r_proximity", "col_tol": "r_col_tol", "stream_gap": "r_stream_gap", "col_gap_min": "r_col_gap_min"}
    out = out.withColumns({k: s * F.col(v) for k, v in named.items()})
    out = out.withColumn("table_pad", F.greatest(F.lit(2.0), s * F.col("r_table_pad")))
    return out.select(*keys, "s", *named, "table_pad", "r_underline", "r_cluster_y_gap", "r_cluster_x_gap", "stream_confidence")


def dominant_font(items: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent font name of each group, the one seen first on ties."""
    counted = items.groupBy(*keys, F.coalesce("font_name", F.lit("")).alias("font_name")).agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    return counted.groupBy(*keys).agg(F.max_by("font_name", F.struct("n", -F.col("first"))).alias("font_name"))


