"""Page relations derived from the tables of a folder.

Each is one SQL text with the table names in braces. ``relation`` runs it on DataFrames
in Spark; ``text`` gives it with plain names, for other engines, where both accept it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Table-like positioned items: four columns for each lineitem of an order.
ITEMS = """
select page, cast(4 * rn + c as bigint) idx, str, cast(60 + 140 * c + l_suppkey % 3 as double) vx, cast(48 + 24 * rn + l_partkey % 5 as double) vy,
  cast(6 * length(str) as double) v_width, case when rn = 0 then 18e0 else 12e0 end v_font
from (select b.*, c.c, case c.c when 0 then cast(l_partkey as varchar(20)) when 1 then cast(l_suppkey as varchar(20)) when 2 then cast(qty as varchar(20)) else rf end str
  from (select l_orderkey page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 rn,
      l_partkey, l_suppkey, cast(l_quantity as bigint) qty, l_returnflag rf from {lineitem}) b
  cross join (values (0), (1), (2), (3)) c(c))"""

#: A ruled grid for each order, with gaps and broken lines.
_SEGMENTS = """
select page, kind, x1, y1, x2, y2, cast(row_number() over (partition by page order by kind, y1, x1, y2, x2) - 1 as bigint) seq from (
with n as (select l_orderkey page, count(*) n from {lineitem} group by l_orderkey),
ks as (select page, n, k from n cross join (values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15),(16),(17),(18),(19),(20)) k(k)),
h as (select page, k, cast(32 + 24 * k + page % 3 as double) y from ks where k <= n),
v as (select page, k r, j from ks cross join (values (0), (1), (2), (3), (4)) j(j) where k < n)
select page, 'H' kind, cast(50 as double) x1, y y1, cast(case when (page + k) % 4 = 0 then 300 else 610 end as double) x2, y y2 from h
union all select page, 'H', cast(305 as double), y, cast(610 as double), y from h where (page + k) % 4 = 0
union all select page, 'V', cast(50 + 140 * j as double), cast(32 + 24 * r as double), cast(50 + 140 * j as double), cast(56 + 24 * r as double) from v where not (j between 1 and 3 and (page + 5 * r + j) % 7 = 0))"""

#: A grid has as many lines as its order asks for.
SEGMENTS = {
    "spark": re.sub(r"ks as \(.*\),", "ks as (select page, n, explode(sequence(0, cast(n as int))) k from n),", _SEGMENTS),
    "duckdb": re.sub(r"ks as \(.*\),", "ks as (select page, n, unnest(range(n + 1)) k from n),", _SEGMENTS),
}

#: Image boxes on pages of 20.
IMAGES = """
select cast(floor(p_partkey / 20) as bigint) page, p_partkey seq, cast((p_partkey * 37) % 500 as double) x, cast((p_partkey * 53) % 700 as double) y, cast(p_size as double) w, cast(p_size + p_partkey % 20 as double) h from {part}"""

#: Page-result upserts.
PAGE_EVENTS = {
    "spark": "select event_id, user_id % 50 as doc_id, cast(get_json_object(props, '$.k') as bigint) % 8 as page_num, ts, event_type, value from {events}",
    "duckdb": "select event_id, user_id % 50 as doc_id, cast(json_extract_string(props, '$.k') as bigint) % 8 as page_num, ts, event_type, value from {events}",
}

#: Text lines as items.
LINES = {
    "spark": "select doc_id, cast(pos as bigint) line_no, line str, 60D vx, cast(40 + 14 * pos as double) vy, cast(6 * length(line) as double) v_width, case when pos = 0 then 18D else 12D end v_font from (select doc_id, posexplode(split(text, '\\n')) as (pos, line) from {documents})",
    "duckdb": "select doc_id, i - 1 line_no, l[i] str, 60::double vx, (40 + 14 * (i - 1))::double vy, (6 * length(l[i]))::double v_width, case when i = 1 then 18::double else 12::double end v_font from (select doc_id, string_split(text, chr(10)) l, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from {documents})",
}

#: Tagged markup of conversations.
MARKUP = {
    "spark": "select conv_id, concat('<page number=\"1\">', array_join(transform(array_sort(collect_list(struct(turn, role, text))), t -> case t.role when 'system' then concat('<section_header>', t.text, '</section_header>') when 'user' then concat('<text>', t.text, '</text>') else concat('<list_item>', t.text, '</list_item>') end), ''), '</page>') raw from {conversations} group by conv_id",
    "duckdb": "select conv_id, concat('<page number=\"1\">', string_agg(case role when 'system' then concat('<section_header>', text, '</section_header>') when 'user' then concat('<text>', text, '</text>') else concat('<list_item>', text, '</list_item>') end, '' order by turn, role, text), '</page>') raw from {conversations} group by conv_id",
}

#: Pairs of documents with the same first line.
DIFF_PAIRS = {
    "spark": "with f as (select doc_id, split(text, '\\n') l from {documents}), g as (select doc_id, l[0] k from f) select a, b from (select doc_id a, lead(doc_id) over (partition by k order by doc_id) b from g) where b is not null",
    "duckdb": "with f as (select doc_id, string_split(text, chr(10)) l from {documents}), g as (select doc_id, l[1] k from f) select a, b from (select doc_id a, lead(doc_id) over (partition by k order by doc_id) b from g) where b is not null",
}

#: Boxes with confidences.
DETECTIONS = {
    "spark": "select cast(label as bigint) page, vec_id id, floor(abs(cast(embedding[0] as double)) * 1000) x, floor(abs(cast(embedding[1] as double)) * 1000) y, 20 + floor(abs(cast(embedding[2] as double)) * 500) w, 20 + floor(abs(cast(embedding[3] as double)) * 500) h, floor(abs(cast(embedding[4] as double)) * 1000) / 1000 conf from {embeddings}",
    "duckdb": "select cast(label as bigint) page, vec_id id, floor(abs(embedding[1]::double) * 1000) x, floor(abs(embedding[2]::double) * 1000) y, 20 + floor(abs(embedding[3]::double) * 500) w, 20 + floor(abs(embedding[4]::double) * 500) h, floor(abs(embedding[5]::double) * 1000) / 1000 conf from {embeddings}",
}

TABLES = ("lineitem", "part", "events", "documents", "conversations", "embeddings", "pages", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, sql: str | dict[str, str]) -> DataFrame:
    sql = sql if isinstance(sql, str) else sql["spark"]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def text(sql: str | dict[str, str]) -> str:
    """The relation for an engine where the tables are views."""
    sql = sql if isinstance(sql, str) else sql["duckdb"]
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
