"""Queries on regions: underlines, dividers, boxes, running heads, lines, blocks, columns, zones, alignment, fonts, captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import box_role, simple_upper
from ..operators import clusters, columns, regions
from ..sources import relations as R
from . import sqltext as S
from .grid import ITEMS, SEGS, K, items, ruled, scaled

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LINES = f"lines as ({S.LINES})"
_ROLE_PATTERNS = {"warning": "WARNING|DANGER|CRITICAL", "caution": "CAUTION|ATTENTION", "note": "NOTE|INFO|INFORMATION|IMPORTANT|NOTICE", "tip": "TIP|HINT|EXAMPLE"}
_ROLES = " ".join(f"when regexp_matches(t, '\\b(?:{p})\\b') then '{r}'" for r, p in _ROLE_PATTERNS.items())
_LISTED = r"regexp_matches(t, '^[•‣◦▪▫–—―·○◉-]\s') or regexp_matches(t, '^(?:\d{1,3}[.)]\s|[a-zA-Z][.)]\s|[ivxIVX]+[.)]\s)')"
_HEAD = r"regexp_matches(t, '(?i)^\d+$|page\s*\d+|\bof\s+\d+\b|©|\bCopyright\b|\bConfidential\b|\bAll Rights Reserved\b')"
#: Lines with a few words put before them, so that list markers, running heads and callouts occur.
_MARKED = "marked as (select *, concat(case doc_id % 17 when 0 then '• ' when 1 then '1. ' when 2 then 'Page 3 of 9 ' when 3 then 'Note: ' when 4 then 'b) ' else '' end, case when line_no % 3 = 0 then str else trim(str) end) t from lines)"


def _lines(spark, sf_dir):
    return R.relation(spark, sf_dir, R.LINES)


def _marked(spark, sf_dir):
    lead = F.expr("case doc_id % 17 when 0 then '• ' when 1 then '1. ' when 2 then 'Page 3 of 9 ' when 3 then 'Note: ' when 4 then 'b) ' else '' end")
    return _lines(spark, sf_dir).withColumn("t", F.concat(lead, F.when(F.col("line_no") % 3 == 0, F.col("str")).otherwise(F.trim("str"))))


def _under(spark, sf_dir):
    """Short rules under every third item."""
    return items(spark, sf_dir).where("idx % 3 = 0").select("page", F.col("idx").alias("seq"), F.col("vx").alias("x1"), (F.col("vy") + F.col("idx") % 6).alias("y1"), (F.col("vx") + F.col("v_width") * (F.lit(1) + F.col("idx") % 2 * 0.5)).alias("x2"), (F.col("vy") + F.col("idx") % 6).alias("y2"))


_UNDER = "u as (select page, idx seq, vx x1, vy + idx % 6 y1, vx + v_width * (1 + (idx % 2) * 0.5e0) x2 from items where idx % 3 = 0)"


@query(f"with {ITEMS}, {_UNDER} select u.page, seq, min(idx) idx from u join items i on i.page = u.page and u.y1 - i.vy >= -1 and u.y1 - i.vy <= i.v_font * 0.35e0 and i.vx <= x2 + 2 and i.vx + i.v_width >= x1 - 2 and x2 - x1 < i.v_width * 1.2e0 where x2 - x1 > 4 and length(trim(str)) > 0 group by 1, 2")
def underlines(spark, sf_dir):
    return regions.underlines(_under(spark, sf_dir), items(spark, sf_dir), K)


@query(f"""with {ITEMS}, {SEGS}, h as (select page, seq, x1, x2, y1 from segs where kind = 'H'), box as (select page, seq, x1 x, y1 - 3 y, x2 - x1 w, 6::double h from h where seq % 4 = 1)
select page, seq, x1 x, y1 - 1 y, x2 - x1 w, 2::double h from h where x2 - x1 >= 660 * 0.15e0
 and not exists (select 1 from box b where b.page = h.page and (x1 + x2) / 2 between b.x - 5 and b.x + b.w + 5 and y1 between b.y - 5 and b.y + b.h + 5)
 and not exists (select 1 from items i where i.page = h.page and abs(i.vy - y1) < 12 * 0.8e0 and i.vx < x2 + 4 and i.vx + i.v_width > x1 - 4)""")
def dividers(spark, sf_dir):
    seg = ruled(spark, sf_dir)
    h = seg.where("kind = 'H' and seq % 4 = 1")
    own = h.select("page", F.col("x1").alias("x"), (F.col("y1") - 3).alias("y"), (F.col("x2") - F.col("x1")).alias("w"), F.lit(6.0).alias("h"))
    return regions.dividers(seg, items(spark, sf_dir), own, K, F.lit(660.0), F.lit(12.0))


@query()
def boxes(spark, sf_dir):
    wide = items(spark, sf_dir).withColumn("v_width", F.col("v_width") * 40)
    return regions.boxes(ruled(spark, sf_dir), wide, K, F.lit(1200.0), F.lit(9.6), 10.8)


@query(f"with {LINES}, {_MARKED}, s as (select doc_id, line_no, substr(upper(t), 1, 60) t from marked) select doc_id, line_no, case {_ROLES} else 'generic' end as role from s where length(t) > 0")
def box_roles(spark, sf_dir):
    sample = simple_upper(F.substring("t", 1, 60))
    return _marked(spark, sf_dir).withColumn("t", sample).where("length(t) > 0").select("doc_id", "line_no", box_role(F.col("t")).alias("role"))


@query(f"""with {LINES}, {_MARKED}, p as (select doc_id, max(vy) + 40 height from lines group by doc_id), r as (select doc_id, line_no, vy, case when line_no % 5 = 4 then 9 else v_font end f, t, height from marked join p using (doc_id))
select doc_id, line_no, case when (vy < height * 0.12e0 or vy > height * 0.88e0) and (length(regexp_replace(t, '\\s', '', 'g')) >= 2 or {_HEAD}) and (f < 12 * 0.85e0 or {_HEAD}) then case when vy < height * 0.12e0 then 'HEADER' else 'FOOTER' end else 'PARAGRAPH' end as type from r""")
def header_footer(spark, sf_dir):
    r = _marked(spark, sf_dir)
    r = r.join(r.groupBy("doc_id").agg((F.max("vy") + 40).alias("height")), "doc_id")
    font = F.when(F.col("line_no") % 5 == 4, 9.0).otherwise(F.col("v_font"))
    r = r.select("doc_id", "line_no", F.lit("PARAGRAPH").alias("type"), F.col("vy").alias("y_center"), font.alias("font_size"), F.col("t").alias("text"), "height")
    return regions.running_heads(r, F.col("height"), F.lit(12.0)).select("doc_id", "line_no", "type")


_CLASS = f"case when tt = '' then null when v_font > 12 * 1.25e0 and length(tt) > 2 then 'HEADING' when {_LISTED.replace('(t,', '(tt,')} then 'LIST' else 'PARAGRAPH' end"
_CLASSED = f"{LINES}, {_MARKED}, classed as (select *, {_CLASS} as type from (select *, regexp_replace(regexp_replace(t, '^\\s+', ''), '\\s+$', '') tt from marked))"


@query(f"with {_CLASSED} select doc_id, line_no, type from classed where type is not null")
def line_classes(spark, sf_dir):
    r = _marked(spark, sf_dir)
    kind = regions.line_class(F.col("t"), F.col("v_font"), F.lit(1), F.lit(12.0))
    return r.select("doc_id", "line_no", kind.alias("type")).where("type is not null")


@query(f"""with {_CLASSED}, spread as (select *, vy + case when line_no % 7 >= 5 then 20 else 0 end y from classed), g as (select *, y - lag(y) over (partition by doc_id order by y, line_no) gap from spread),
o as (select *, case when type = lag(type) over (partition by doc_id order by y, line_no) and not gap > 12 * 1.8e0 then 0 else 1 end opens from g where type is not null),
b as (select *, sum(opens) over (partition by doc_id order by y, line_no rows unbounded preceding) - 1 as block from o)
select doc_id, cast(block as bigint) as block, type, count(*) n_lines, min(60::double) x, min(y) y, max(v_width) w, max(y) - min(y) + avg(v_font) h, avg(v_font) font_size from b group by 1, 2, 3""")
def blocks(spark, sf_dir):
    r = _marked(spark, sf_dir)
    kind = regions.line_class(F.col("t"), F.col("v_font"), F.lit(1), F.lit(12.0))
    y = F.col("vy") + F.when(F.col("line_no") % 7 >= 5, 20).otherwise(0)
    r = r.select("doc_id", kind.alias("type"), F.col("v_font").alias("font"), F.lit(1).alias("n_items"), y.alias("y"), F.col("vx").alias("x_min"), (F.col("vx") + F.col("v_width")).alias("x_max"), y.alias("y_max"))
    return regions.blocks(r, ["doc_id"], F.lit(12 * 1.8)).drop("n_items")


def _two_columns(spark, sf_dir):
    """Items of narrow prose in two columns on shifted lines."""
    it = scaled(spark, sf_dir)
    right = F.col("idx") % 2 == 1
    it = it.withColumn("vx", F.when(right, 420.0).otherwise(60.0) + F.col("idx") % 3).withColumn("vy", 48 + F.floor(F.col("idx") / 2) * 30 + F.when(right, 15.0).otherwise(0.0)).withColumn("v_width", F.lit(150.0))
    return it.withColumn("width", F.lit(660.0))


@query()
def page_columns(spark, sf_dir):
    banded = clusters.y_bands(_two_columns(spark, sf_dir), K, F.col("y_band_tol"))
    return columns.page_columns(banded, K)


@query(f"with {ITEMS}, s as (select page, idx, case when vx >= 340 then 2 when vx >= 180 and page % 2 = 0 then 1 else 0 end b from items where not (page % 5 = 0 and vx < 180)) select page, idx, dense_rank() over (partition by page order by b) - 1 as column from s")
def column_buckets(spark, sf_dir):
    it = items(spark, sf_dir).where("not (page % 5 = 0 and vx < 180)")
    splits = it.select("page").distinct().withColumn("splits", F.when(F.col("page") % 2 == 0, F.array(F.lit(180.0), F.lit(340.0))).otherwise(F.array(F.lit(340.0), F.lit(340.0))))
    # equal splits leave an empty column between them, which gets no number
    return columns.column_buckets(it, splits, K).select("page", "idx", "column")


_REGIONS = "r as (select doc_id, line_no id, vy y, vy + 5 y_center, case when line_no % 6 < 2 then -1 else line_no % 2 end as column from lines)"


def _regions(spark, sf_dir):
    col = F.when(F.col("line_no") % 6 < 2, -1).otherwise(F.col("line_no") % 2)
    return _lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("id"), F.col("vy").alias("y"), (F.col("vy") + 5).alias("y_center"), col.alias("column"))


@query(f"""with {LINES}, {_REGIONS}, o as (select *, case when (r.column = -1) = lag(r.column = -1) over (partition by doc_id order by y_center, id) then 0 else 1 end opens from r),
z as (select *, sum(opens) over (partition by doc_id order by y_center, id rows unbounded preceding) - 1 as zone from o),
g as (select doc_id, zone, z.column = -1 full_w, floor(arg_min(y, y_center * 100000 + id)) y0, count(*) n_regions from z group by 1, 2, 3),
h as (select *, case when zone = 0 then 0 else y0 end y00 from g)
select doc_id, cast(zone as bigint) as zone, cast(y00 as bigint) y0, cast(coalesce(lead(y00) over (partition by doc_id order by zone), 99999) as bigint) y1, cast(case when full_w then 1 else 2 end as bigint) as cols, n_regions from h""")
def zones(spark, sf_dir):
    return columns.zones(_regions(spark, sf_dir), ["doc_id"], F.lit(2))


@query(f"with {LINES}, {_REGIONS}, s as (select doc_id, id, y + (id * id) % 11 y from r), g as (select *, y - lag(y) over (partition by doc_id order by y, id) gap, (y + lag(y) over (partition by doc_id order by y, id)) / 2 cut from s) select doc_id, arg_max(gap, gap * 1000000 - y) gap, arg_max(cut, gap * 1000000 - y) cut from g where gap is not null group by doc_id")
def zone_largest_gap(spark, sf_dir):
    r = _regions(spark, sf_dir).withColumn("y", F.col("y") + F.col("id") * F.col("id") % 11)
    return columns.largest_gap(r, ["doc_id"])


@query(f"""with recursive {ITEMS}, p as (select page, list_sort(list(v_font))[len(list(v_font)) // 2 + 1] mf, max(vx + v_width) - min(vx) bw, count(*) n from items group by page), j as (select items.*, mf, bw, n from items join p using (page)),
{S.fold('j', 'b', 'page', 'vy', 'idx', 'mf * 0.45e0', 'anchor')}, e as (select page, grp, bw, n, min(vx) l, max(vx + v_width) r from b group by 1, 2, 3, 4),
d as (select page, n, count(*) as lines, coalesce(stddev_pop(l), 0) / case when bw = 0 then 1 else bw end sl, coalesce(stddev_pop(r), 0) / case when bw = 0 then 1 else bw end sr, coalesce(stddev_pop((l + r) / 2), 0) / case when bw = 0 then 1 else bw end sm from e group by page, n, bw)
select page, lines, case when n < 2 or lines < 2 then 'left' when sl < 0.01 and sr < 0.03 then 'justify' when sm < 0.02 then 'center' when sr < 0.01 and sl > 0.02 then 'right' else 'left' end align from d""")
def alignment(spark, sf_dir):
    return columns.alignment(items(spark, sf_dir), K)


_NAMES = ["ABCDEF+Arial-BoldMT", "TimesNewRomanPS-Italic", "Courier", "Garamond-Regular", "F1", "Georgia,Bold", "QWERTY+Helvetica-Oblique"]


@query(f"""with {ITEMS}, u as (select page % 10 doc, page, idx, list_extract([{', '.join(f"'{n}'" for n in _NAMES)}], cast((idx + page) % 7 + 1 as int)) nm, v_font + (idx % 2) * 0.5e0 fs from items),
f as (select doc, page, idx, case (idx + page) % 7 when 0 then 'Arial, sans-serif' when 1 then '"Times New Roman", serif' when 2 then '"Courier New", monospace' when 3 then 'Garamond, serif' when 4 then 'inherit' when 5 then 'Georgia, serif' else 'Arial, sans-serif' end family,
  cast(floor(fs + 0.5) as bigint) size, (idx + page) % 7 in (0, 5) bold, (idx + page) % 7 in (1, 6) italic from u), d as (select doc, family, size, bold, italic, min(page * 100000 + idx) o from f group by 1, 2, 3, 4, 5)
select doc, family, size, bold, italic, concat('f', row_number() over (partition by doc order by o) - 1) as class from d""")
def font_registry(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in _NAMES])
    used = items(spark, sf_dir).select((F.col("page") % 10).alias("doc"), "page", "idx", F.element_at(names, ((F.col("idx") + F.col("page")) % 7 + 1).cast("int")).alias("font_name"), (F.col("v_font") + F.col("idx") % 2 * 0.5).alias("font_size"))
    return columns.font_registry(used, ["doc"], ["page", "idx"]).drop("css")


_FIGS = "figs as (select doc_id, line_no id, case when line_no % 3 = 0 then 'IMAGE' else 'PARAGRAPH' end as type, case when line_no % 2 = 0 then 60 else 90 end x, vy y, 200 w, 10 + line_no % 4 * 15 h, case when line_no % 4 = 1 then concat('Figure ', line_no) else t end as text from marked)"


@query(f"""with {LINES}, {_MARKED}, {_FIGS}, n as (select *, lead(id) over w nid, lead(type) over w nt, lead(x) over w nx, lead(y) over w ny, lead(w) over w nw, lead(text) over w ntx from figs window w as (partition by doc_id order by id))
select doc_id, id image, nid caption from n where type = 'IMAGE' and nt = 'PARAGRAPH' and ny - (y + h) between -10 and 45 and (regexp_matches(ntx, '(?i)(?:Figure|Fig\\.|Table|Exhibit)\\s*\\d+') or (length(ntx) < 150 and abs((nx + nw / 2) - (x + w / 2)) < 30))""")
def figure_captions(spark, sf_dir):
    n = F.col("line_no")
    text = F.when(n % 4 == 1, F.concat(F.lit("Figure "), n.cast("string"))).otherwise(F.col("t"))
    figs = _marked(spark, sf_dir).select("doc_id", n.alias("id"), F.when(n % 3 == 0, "IMAGE").otherwise("PARAGRAPH").alias("type"), F.when(n % 2 == 0, 60.0).otherwise(90.0).alias("x"), F.col("vy").alias("y"), F.lit(200.0).alias("w"), (10 + n % 4 * 15).alias("h"), text.alias("text"))
    return regions.captions(figs, ["doc_id"], "id")


@query(f"""with images as ({S.IMAGES}), own as (select * from images where seq % 4 = 0), auto as (select * from images where seq % 4 <> 0)
select page, seq from auto a where not exists (select 1 from own o where o.page = a.page and least(a.x + a.w, o.x + o.w) > greatest(a.x, o.x) and least(a.y + a.h, o.y + o.h) > greatest(a.y, o.y) and a.w * a.h > 0
 and (least(a.x + a.w, o.x + o.w) - greatest(a.x, o.x)) * (least(a.y + a.h, o.y + o.h) - greatest(a.y, o.y)) / (a.w * a.h) > 0.1)""")
def region_overlap_suppression(spark, sf_dir):
    images = R.relation(spark, sf_dir, R.IMAGES)
    return regions.without_covered(images.where("seq % 4 <> 0"), images.where("seq % 4 = 0"), K, 0.1, at_least=False).select("page", "seq")
