"""Queries on document properties, colours, region edits and small region operators, over image boxes and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import detections, editing, lattice, regions, scale, spatial, text, versions
from ..sources import relations as R
from . import sqltext as S
from .grid import K

QUERIES, ORACLES = {}, {}
_IMAGES = f"images as ({S.IMAGES})"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _images(spark, sf_dir):
    return R.relation(spark, sf_dir, R.IMAGES)


@query("""with d as (select doc_id, n_chars::bigint * 97 n from documents)
select doc_id, case when doc_id % 3 <> 0 then concat('1.', doc_id % 8) else 'unknown' end as version, case when doc_id % 5 = 0 then '' when doc_id % 2 = 0 then concat('2020-01-', 10 + doc_id % 19) else 'raw' end created,
case when n < 1024 then concat(n, ' B') when n < 1048576 then printf('%.1f KB', floor(n / 1024e0 * 10 + 0.5) / 10) else printf('%.2f MB', floor(n / 1048576e0 * 100 + 0.5) / 100) end size, printf('%.2f', floor(doc_id / 72e0 * 100 + 0.5) / 100) width from d""")
def document_properties(spark, sf_dir):
    d = R.table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("%PDF-1."), (F.col("doc_id") % 8).cast("string"), F.lit("\n"))).otherwise("")
    date = F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("D:202001"), (10 + F.col("doc_id") % 19).cast("string"), F.lit("1200"))).otherwise("raw")
    content = F.encode(F.concat(head, F.lit("body of the file")), "UTF-8")
    return d.select("doc_id", exprs.pdf_version(content).alias("version"), exprs.pdf_date(date).alias("created"), exprs.byte_size(F.col("n_chars").cast("long") * 97).alias("size"), exprs.inches(F.col("doc_id").cast("double")).alias("width"))


_CMYK = "list_transform([c, m, y], lambda v: (1 - v) * (1 - k))"


@query(f"""with {_IMAGES}, i as (select page, seq, (seq % 11) / 10e0 c, (seq % 7) / 6e0 m, (seq % 5) / 4e0 y, (seq % 3) / 4e0 k from images)
select page, seq, array_to_string(list_transform({_CMYK}, lambda v: printf('%02x', floor(v * 255 + 0.5)::bigint)), '') cmyk, repeat(printf('%02x', floor(c * 255 + 0.5)::bigint), 3) gray from i""")
def colours(spark, sf_dir):
    part = lambda n, by: (F.col("seq") % n) / F.lit(float(by))
    return _images(spark, sf_dir).select("page", "seq", exprs.hex_color(exprs.cmyk_rgb(part(11, 10), part(7, 6), part(5, 4), part(3, 4))).alias("cmyk"), exprs.hex_color(exprs.gray_rgb(part(11, 10))).alias("gray"))


@query(f"""with {_IMAGES}, b as (select page, seq, greatest(0e0, floor(x * 2)) cx, greatest(0e0, floor(y * 2)) cy, least(900e0, ceil((x + w) * 2)) r, least(1000e0, ceil((y + h) * 2)) l from images)
select page, seq, cx, cy, r - cx cw, l - cy ch from b where r - cx >= 4 and l - cy >= 4""")
def image_crops(spark, sf_dir):
    return editing.crop_boxes(_images(spark, sf_dir), F.lit(450.0), F.lit(500.0)).select("page", "seq", "cx", "cy", "cw", "ch")


@query(f"with {_IMAGES} select page, seq, least(0.5e0, greatest(0.12e0, coalesce(case when seq % 4 <> 0 then (seq % 10) / 10e0 end, 1e0) * 0.5e0)) alpha from images")
def overlay_alphas(spark, sf_dir):
    return _images(spark, sf_dir).select("page", "seq", editing.overlay_alpha(F.when(F.col("seq") % 4 != 0, (F.col("seq") % 10) / F.lit(10.0))).alias("alpha"))


@query(f"""with {_IMAGES}, r as (select page, seq, seq % 2 + 1 page_num, case when seq % 3 = 0 then 'HEADING' else 'TEXT' end type, w font_size from images),
f as (select page, seq top, font_size from (select *, row_number() over (partition by page order by font_size desc, seq) n from r where type = 'HEADING' and page_num = 1) where n = 1 and font_size > 20)
select r.page, r.seq, f.top is not null is_h1, case when f.top is not null then 'h1' when r.font_size > 18 then 'h2' else 'h3' end tag from r left join f on r.page = f.page and r.seq = f.top""")
def heading_promotion(spark, sf_dir):
    r = _images(spark, sf_dir).select("page", "seq", (F.col("seq") % 2 + 1).alias("page_num"), F.when(F.col("seq") % 3 == 0, "HEADING").otherwise("TEXT").alias("type"), F.col("w").alias("font_size"))
    return editing.promoted_heading(r, K).select("page", "seq", "is_h1", editing.heading_tag(F.col("font_size"), F.col("is_h1")).alias("tag"))


@query(f"with {_IMAGES}, m as (select *, case when seq % 6 = 0 then '***' when seq % 2 = 0 then '**' when seq % 3 = 0 then '*' else '' end k from images) select page, seq, concat(k, 't', seq, k) md from m")
def styled_marks(spark, sf_dir):
    return _images(spark, sf_dir).select("page", "seq", editing.styled_markdown(F.concat(F.lit("t"), F.col("seq").cast("string")), F.col("seq") % 2 == 0, F.col("seq") % 3 == 0).alias("md"))


@query(f"""with {_IMAGES}, i as (select page, case when seq % 9 = 0 then '' else concat('F', w::bigint % 4) end font_name, seq from images), c as (select page, font_name, count(*) n, min(seq) f from i group by 1, 2)
select page, font_name from (select *, row_number() over (partition by page order by n desc, f) k from c) where k = 1""")
def dominant_fonts(spark, sf_dir):
    name = F.when(F.col("seq") % 9 != 0, F.concat(F.lit("F"), (F.col("w").cast("long") % 4).cast("string")))
    return scale.dominant_font(_images(spark, sf_dir).select("page", F.col("seq").alias("idx"), name.alias("font_name")), K)


@query(f"with {_IMAGES}, i as (select page, concat('T', seq % 3) type, case when seq % 4 <> 0 then (seq % 10) / 10e0 end c from images) select page, type, count(*) n, count(*) filter (coalesce(c, 1) >= 0.5) visible from i group by 1, 2")
def region_type_counts(spark, sf_dir):
    r = _images(spark, sf_dir).select("page", F.concat(F.lit("T"), (F.col("seq") % 3).cast("string")).alias("type"), F.when(F.col("seq") % 4 != 0, (F.col("seq") % 10) / F.lit(10.0)).alias("confidence"))
    return regions.region_counts(r, K, 0.5)


@query("""with e as (select vec_id id, list_transform(embedding[1:4], lambda v: abs(v::double)) s, embedding[5]::double cx, embedding[6]::double cy, abs(embedding[7]::double) w, abs(embedding[8]::double) h from embeddings)
select id, list_max(s) conf, list_position(s, list_max(s)) - 1 class_id, cx - w / 2 x, cy - h / 2 y, w, h from e where list_max(s) >= 0.25""")
def detections_decoded(spark, sf_dir):
    at = lambda i: F.col("embedding")[i].cast("double")
    raw = R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(*[F.abs(at(i)) for i in range(4)]).alias("scores"), at(4).alias("cx"), at(5).alias("cy"), F.abs(at(6)).alias("w"), F.abs(at(7)).alias("h"))
    return detections.decoded(raw).select("id", "conf", "class_id", "x", "y", "w", "h")


@query(f"with {_IMAGES} select page, seq, case when seq % 7 = 0 then x + 1 else x end x from images")
def patched_regions(spark, sf_dir):
    base = _images(spark, sf_dir).select("page", "seq", "x")
    return versions.patched(base, base.where("seq % 7 = 0").withColumn("x", F.col("x") + 1), ["page", "seq"])


@query(f"with {_IMAGES} select page, seq, x + least(10e0, w - 4) x, y + least(-5e0, h - 4) y, greatest(4e0, w - least(10e0, w - 4) - 20) w, greatest(4e0, h - least(-5e0, h - 4) + 3) h from images")
def resized_regions(spark, sf_dir):
    moved = versions.resized(_images(spark, sf_dir), F.lit(10.0), F.lit(-5.0), "nw")
    return versions.resized(moved, F.lit(-20.0), F.lit(3.0), "se").select("page", "seq", "x", "y", "w", "h")


@query(f"""with {_IMAGES}, p as (select distinct page, x from images where seq % 4 <> 0 and x > 25 and x < 475), r as (select page, x from images where seq % 4 = 0),
k as (select page, x from p where not exists (select 1 from r where r.page = p.page and abs(r.x - p.x) <= 8))
select i.page, coalesce(string_agg(x::bigint::varchar, ',' order by x), '') splits from (select distinct page from images) i left join k using (page) group by i.page""")
def manual_splits(spark, sf_dir):
    edits = _images(spark, sf_dir).select("page", F.when(F.col("seq") % 4 == 0, "remove").otherwise("place").alias("action"), "x")
    return versions.split_lists(edits, K, F.lit(500.0)).select("page", F.array_join(F.transform("splits", lambda x: x.cast("long").cast("string")), ",").alias("splits"))


@query(f"with {_IMAGES} select distinct page, seq % 5 as row, seq % 3 as ord from images where seq % 4 = 2")
def cells_of_a_row(spark, sf_dir):
    slots = _images(spark, sf_dir).select("page", (F.col("seq") % 5).alias("row"), (F.col("seq") % 3).alias("ord"), (F.col("seq") % 4).alias("r"))
    return lattice.cells_in(slots, K, "r", 2)


@query(f"with {_IMAGES} select distinct page from images where page % 2 = 0 and page % 3 <> 0")
def phantom_grids(spark, sf_dir):
    cells = _images(spark, sf_dir).select("page", F.when(F.col("page") % 2 == 0, 0).otherwise(F.col("seq") % 3).alias("r"), F.lit(0).alias("c"))
    four, three = F.array(*[F.lit(float(i)) for i in range(4)]), F.array(*[F.lit(float(i)) for i in range(3)])
    grids = cells.select("page").distinct().select("page", F.when(F.col("page") % 3 != 0, four).otherwise(three).alias("rows"), four.alias("cols"))
    return lattice.phantom(cells, grids, K)


@query(f"""with {_IMAGES} select page, seq, c as column from images, (values (0, 0e0, 150e0), (1, 150e0, 300e0), (2, 300e0, 1e9)) b(c, lo, hi) where page % 3 <> 0 and x >= lo - 1 and x < hi
union all select page, seq, 0 from images where page % 3 = 0""")
def items_by_column(spark, sf_dir):
    im = _images(spark, sf_dir)
    splits = im.where("page % 3 <> 0").select("page").distinct().select("page", F.explode(F.array(F.lit(150.0), F.lit(300.0))).alias("x"))
    return text.column_lines(im, splits, K).select("page", "seq", "column")


@query(f"""with {_IMAGES}, c as (select page, seq, x + w / 2 px, y + h / 2 py from images) select page, seq as id, case when px between 100 and 250 and py between 100 and 250 then 'lattice' when px between 300 and 400 and py between 300 and 500 then 'bordered-box'
when px between 40 and 310 and py between 40 and 310 then 'near-table' else 'open-text' end kind from c""")
def region_kinds(spark, sf_dir):
    im = _images(spark, sf_dir).withColumnRenamed("seq", "id")
    box = lambda x, y, w, h: im.select("page").distinct().select("page", F.lit("b").alias("id"), *[F.lit(float(v)).alias(n) for n, v in zip("xywh", (x, y, w, h), strict=True)])
    return spatial.region_kind(im, box(100, 100, 150, 150), box(300, 300, 100, 200), K).select("page", "id", "kind")


@query(f"""with {_IMAGES}, j as (select page, seq, y, lag(y) over (partition by page order by seq) - y jump from images), g as (select page, count(*) n, max(y) - min(y) span, max(jump) jump from j group by page)
select g.page, g.jump, min(j.seq) at_ord from g join j on g.page = j.page and g.jump = j.jump where n >= 6 and span >= 40 and g.jump >= 0.2 * span group by g.page, g.jump""")
def column_hints(spark, sf_dir):
    return spatial.column_hint(_images(spark, sf_dir).select("page", F.col("seq").alias("ord"), F.col("y").alias("vy")), K)


@query(f"""with {_IMAGES}, f as (select * from images where seq % 5 = 0), m as (select i.page, i.seq, min(f.seq) fs from images i join f on i.page = f.page and least(i.x + i.w, f.x + f.w) > greatest(i.x, f.x) and least(i.y + i.h, f.y + f.h) > greatest(i.y, f.y) group by 1, 2)
select i.page, i.seq, concat('#', fs) fill_color from images i left join m using (page, seq)""".replace("concat('#', fs)", "case when fs is not null then concat('#', fs) end"))
def first_fills(spark, sf_dir):
    im = _images(spark, sf_dir)
    fills = im.where("seq % 5 = 0").withColumn("fill_color", F.concat(F.lit("#"), F.col("seq").cast("string")))
    return regions.first_fill(im, fills, K).select("page", "seq", "fill_color")
