"""Pieces of the comparison SQL that several queries share."""

from __future__ import annotations

from ..sources import relations as R

ITEMS, SEGMENTS, IMAGES = R.text(R.ITEMS), R.text(R.SEGMENTS), R.text(R.IMAGES)
LINES, MARKUP, DIFF_PAIRS, DETECTIONS, PAGE_EVENTS = map(R.text, (R.LINES, R.MARKUP, R.DIFF_PAIRS, R.DETECTIONS, R.PAGE_EVENTS))


def scale(items: str = "items", key: str = "page") -> str:
    """scale(key, s): the modal font of each page, by half-pixel bins, first seen on ties."""
    return f"""scale as (select {key}, max_by(bin, n * 1000000 - first) s from (select {key}, floor(v_font * 2 + 0.5) / 2 bin, count(*) n, min(idx) first from {items} where length(trim(str)) > 0 group by 1, 2) group by 1)"""


def fold(source: str, name: str, keys: str, value: str, order: str, tol: str, mode: str) -> str:
    """name(source.*, grp): rows numbered into groups by the same rule as the library's fold."""
    on = " and ".join(f"o.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    picked = ", ".join(f"o.{k.strip()}" for k in keys.split(","))
    near = f"abs({'f.m / f.n' if mode == 'members' else 'f.m'} - o.v) <= o.tol"
    moved = {"running": "(f.m * f.n + o.v) / (f.n + 1)", "members": "f.m + o.v", "anchor": "f.m"}[mode]
    return f"""{name}_o as (select *, {value} v, {tol} tol, row_number() over (partition by {keys} order by {value}, {order}) rn from {source}),
{name}_f as (select {keys}, rn, v m, 1::double n, 0::bigint g from {name}_o where rn = 1
  union all select {picked}, o.rn, case when {near} then {moved} else o.v end, case when {near} then f.n + 1 else 1 end, case when {near} then f.g else f.g + 1 end from {name}_f f join {name}_o o on {on} and o.rn = f.rn + 1),
{name} as (select o.*, f.g grp, f.m ref from {name}_o o join {name}_f f on {on} and o.rn = f.rn)"""


def merged(source: str, name: str, part: str, lo: str, hi: str, slack: str) -> str:
    """name(part, lo, hi, members): intervals merged where one starts within slack of the farthest end so far."""
    return f"""{name}_r as (select *, max({hi}) over (partition by {part} order by {lo}, {hi} rows between unbounded preceding and 1 preceding) reach from {source}),
{name}_i as (select *, sum(case when reach is null or {lo} > reach + {slack} then 1 else 0 end) over (partition by {part} order by {lo}, {hi} rows unbounded preceding) run from {name}_r),
{name} as (select {part}, min({lo}) {lo}, max({hi}) {hi}, count(*) members from {name}_i group by {part}, run)"""


ORIENT = "case when abs(y2 - y1) <= 4 and abs(x2 - x1) > 4 then 'H' when abs(x2 - x1) <= 4 and abs(y2 - y1) > 4 then 'V' when abs(x2 - x1) > 2 and abs(y2 - y1) > 2 then 'diag' end"
