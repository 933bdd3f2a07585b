"""Drawing operators of pages: graphics state, paths, images, and their reduction to segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.lineage import cut
from ..functions.exprs import apply_affine, compose_affine
from . import drawing, segments
from .drawing import FILLS, IDENTITY, SIZES, STROKES

SUBPATH = "id long, segs array<array<double>>, curves array<array<double>>, closed boolean, filled boolean, stroke_width double, stroke_color array<double>, fill_color array<double>, construct_path_id long, ctm array<double>"


def _product(a: tuple, b: tuple) -> tuple:
    return (
        a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3],
        a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5],
    )


def _color(kind: str, args: list[float], old: tuple) -> tuple:
    """Gray, RGB or CMYK arguments as RGB; by count where the operator does not say."""
    if "CMYK" in kind:
        return tuple((1 - x) * (1 - args[3]) for x in args[:3])
    if len(args) == 1 or "Gray" in kind:
        return (args[0],) * 3
    return tuple(args[:3]) if len(args) >= 3 else old


class PageState:
    """The graphics state of one page, and what its operators have drawn. compat keeps the one-pending-rectangle and stale-start rules."""

    def __init__(self, viewport: tuple, compat: bool = True):
        self.viewport, self.compat = viewport, compat
        self.ctm, self.saved = IDENTITY, []
        self.width, self.fill, self.stroke = 1.0, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)
        self.at = self.start = (0.0, 0.0)
        self.paths: list[dict] = []
        self.current: dict | None = None
        self.pending: list[tuple] = []
        self.fills: list[tuple] = []
        self.images: list[tuple] = []
        self.made = self.batches = 0
        self._open(None)

    def _open(self, batch: int | None) -> None:
        if self.current and (self.current["segs"] or self.current["curves"]):
            self.paths.append(self.current)
        self.current = {"id": self.made, "segs": [], "curves": [], "closed": False, "filled": False, "stroke_width": self.width, "stroke_color": self.stroke, "fill_color": self.fill, "construct_path_id": batch, "ctm": self.ctm}
        self.made += 1

    def _seen(self, x: float, y: float) -> tuple[float, float]:
        for m in (self.ctm, self.viewport):
            x, y = m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]
        return x, y

    def _box(self, a: tuple, b: tuple) -> tuple:
        (x1, y1), (x2, y2) = self._seen(*a), self._seen(*b)
        return min(x1, x2), min(y1, y2), abs(x2 - x1), abs(y2 - y1)

    def _line(self, to: tuple) -> None:
        self.current["segs"].append((*self.at, *to))
        self.at = to

    def draw(self, fn: str, a: list[float], batch: int | None = None) -> None:
        """One path operator."""
        if fn == "moveTo":
            self._open(batch)
            self.at = self.start = (a[0], a[1])
        elif fn == "lineTo":
            self._line((a[0], a[1]))
        elif fn == "closePath":
            self._line(self.start)
            self.current["closed"] = True
        elif fn == "rectangle":
            x, y, w, h = a
            self._open(batch)
            corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
            self.current["segs"] += [(*p, *q) for p, q in zip(corners, corners[1:], strict=False)]
            box = (*self._box((x, y), (x + w, y + h)), self.fill)
            self.pending = [box] if self.compat else [*self.pending, box]
            self.at = (x, y)
            if not self.compat:
                self.start = self.at
        else:
            points = [tuple(a[i : i + 2]) for i in range(0, len(a), 2)]
            first = {"curveTo": points, "curveTo2": [self.at, *points], "curveTo3": [*points, points[-1]]}[fn]
            self.current["curves"].append([v for p in (self.at, *first) for v in p])
            self.at = first[-1]

    def apply(self, fn: str, a: list[float], sub_ops: list[str] | None, sub_args: list[float] | None, image_id: str | None) -> None:
        if fn in SIZES:
            self.draw(fn, a)
        elif fn == "constructPath":
            k = 0
            for sub in sub_ops:
                self.draw(sub, list(sub_args[k : k + SIZES[sub]]), self.batches)
                k += SIZES[sub]
            self.batches += 1
        elif fn == "save":
            self.saved.append((self.ctm, self.fill, self.stroke))
        elif fn == "restore":
            self.ctm, *colors = self.saved.pop() if self.saved else (IDENTITY, self.fill, self.stroke)
            self.fill, self.stroke = colors
        elif fn == "transform":
            self.ctm = _product(self.ctm, tuple(a))
        elif fn == "setLineWidth":
            self.width = a[0]
        elif fn.startswith("setFill"):
            self.fill = _color(fn, a, self.fill)
        elif fn.startswith("setStroke"):
            self.stroke = _color(fn, a, self.stroke)
        elif fn in FILLS:
            self.current["filled"] = True
            self.fills += self.pending
            self.pending = []
        elif fn in STROKES:
            self.pending = []
        elif fn.startswith("paint"):
            x, y, w, h = self._box((0, 0), (1, 1))
            if "Mask" in fn or "Inline" in fn:
                if w > 8 and h > 8:
                    self.images.append((("mask_" if "Mask" in fn else "inline_") + str(len(self.images)), x, y, w, h, True))
            elif image_id is not None:
                self.images.append((image_id, x, y, w, h, False))

    def finish(self) -> None:
        self._open(None)


#: Operators that are taken up at a time, and rows of a returned batch.
OPS_AT_ONCE, ROWS_OUT = 1_000_000, 65_536


def _values(column: pa.Array) -> list:
    """A column as a Python list, by way of numpy, which is several times faster."""
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_floating(column.type) and not column.null_count:
        return column.to_numpy().tolist()
    coded = column.dictionary_encode()
    names = [*coded.dictionary.tolist(), None]
    return [names[i] for i in coded.indices.fill_null(len(names) - 1).to_numpy().tolist()]


def _lists(column: pa.Array) -> list:
    """A list column as Python lists, by its flat values."""
    if column.null_count == len(column):
        return [None] * len(column)
    flat, at = _values(column.flatten()), [0, *np.cumsum(column.value_lengths().fill_null(0).to_numpy()).tolist()]
    known = column.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [flat[i:j] if there else None for there, i, j in zip(known, at, at[1:], strict=False)]


def _chunks(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[dict[str, pa.Array], np.ndarray]]:
    """Rows of whole pages as columns, in the order of op_seq, with each page's first row; a page goes on where the keys don't change."""
    kept, n_ops, limit = [], 0, OPS_AT_ONCE

    def table() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(kept).combine_chunks()
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for k in range(n_keys):
            code = rows.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return rows, np.flatnonzero(new)

    def columns(rows: pa.Table, starts: np.ndarray) -> tuple[dict[str, pa.Array], np.ndarray]:
        seq, page = rows.column("op_seq").to_numpy(), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
        if ((seq[1:] < seq[:-1]) & (page[1:] == page[:-1])).any():
            rows = rows.take(pa.array(np.lexsort((seq, page))))
        return {name: (c.chunk(0) if (c := rows.column(name)).num_chunks == 1 else c.combine_chunks()) for name in rows.column_names}, starts

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        n_ops += batch.num_rows + (pc.sum(pc.count_substring(batch.column(batch.schema.get_field_index("fn")), " ")).as_py() or 0)
        if n_ops >= limit:
            rows, starts = table()
            if len(starts) > 1:
                yield columns(rows.slice(0, starts[-1]).combine_chunks(), starts[:-1])
                kept, n_ops, limit = rows.slice(starts[-1]).to_batches(), 0, OPS_AT_ONCE
            else:
                limit = 2 * n_ops
    if kept:
        yield columns(*table())


def _one_page(ops: drawing.Ops, k: int, compat: bool) -> PageState:
    """The operators of a page through a PageState."""
    state = PageState(tuple(ops.vp[:, k].tolist()), compat)
    for o in range(ops.first[k], ops.first[k] + ops.size[k]):
        name = ops.names[ops.code[o]] if ops.code[o] >= 0 else None
        if ops.batch is not None and ops.batch[o] >= 0:
            state.draw(name, ops.args(o), int(ops.batch[o]))
        else:
            state.apply(name, ops.args(o), None, None, ops.image[o].as_py() if ops.image is not None else None)
    state.finish()
    return state


def _folded(ops: DataFrame, pages: DataFrame | tuple, keys: list[str], schema: str, want: str, rows: Callable, compat: bool) -> DataFrame:
    """Operators of pages through their graphics states; rows(drawing, states, ops) yields the output: pages, then columns. States don't commute, so a page is one fold.

    Pages are folded side by side, some thousands at a time (``drawing``); the longest of them, and all without compat, by themselves.
    The window over the keys brings pages together, at no cost where they stand so already; memory follows the largest page.
    """
    fields = {f.name: f.dataType.simpleString() for f in ops.schema}
    one = None if isinstance(pages, DataFrame) else tuple(map(float, pages))
    if one is None:
        ops = ops.join(pages.select(*keys, "vp"), keys)
    names = ["op_seq", "fn", "args", *[c for c in ("sub_ops", "sub_args", "image_id") if fields.get(c, "void") != "void"], *(["vp"] if one is None else [])]
    gathered = ops.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).select(*keys, *names, "_n")
    out_schema = T._parse_datatype_string(", ".join(f"{k} {fields[k]}" for k in keys) + ", " + schema)
    types, n = [f.type for f in to_arrow_schema(out_schema)][len(keys) :], len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts in _chunks(batches, n):
            vp = np.array([one] * len(starts)).T if one else np.array(columns["vp"].take(pa.array(starts)).to_pylist(), np.float64).T
            flat = drawing.flat({c: columns[c] for c in names if c not in ("op_seq", "vp")}, starts, vp)
            alone = drawing.apart(flat) if compat else np.ones(len(starts), bool)
            states = {int(k): _one_page(flat, k, compat) for k in np.flatnonzero(alone)}
            parts = [drawing.drawn(flat, np.flatnonzero(~alone), want), *[drawing.of_state(s, k) for k, s in states.items()]]
            page, made = rows(drawing.joined(parts), states, flat)
            where = pa.array(starts[page.astype(np.int64)])
            made = [*[columns[k].take(where) for k in keys], *[c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(made, types, strict=True)]]
            whole = pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(made, [*[columns[k].type for k in keys], *types], strict=True)], names=out_schema.names)
            for lo in range(0, whole.num_rows, ROWS_OUT):
                yield whole.slice(lo, ROWS_OUT)

    return gathered.mapInArrow(run, out_schema)


def subpaths(ops: DataFrame, pages: DataFrame | tuple, keys: list[str], compat: bool = True) -> DataFrame:
    """Subpaths of pages. ops: op_seq, fn (or several, a blank between), args, and where they occur sub_ops, sub_args, image_id; pages: the viewport matrix vp, or one for all."""

    def rows(d: drawing.Drawing, states, flat) -> tuple:
        p = d.paths
        ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        batch = pa.array(p[11].astype(np.int64), mask=p[11] < 0)
        nested = [pa.ListArray.from_arrays(ends(p[k]), drawing.lists(v)) for k, v in ((18, d.segs), (19, d.curves))]
        return p[0], [p[1].astype(np.int64), *nested, p[2] > 0, p[3] > 0, p[4], drawing.lists(p[5:8]), drawing.lists(p[8:11]), batch, drawing.lists(p[12:18])]

    return _folded(ops, pages, keys, SUBPATH, "paths", rows, compat)


def filled_rects(ops: DataFrame, pages: DataFrame | tuple, keys: list[str], compat: bool = True) -> DataFrame:
    """Filled rectangles in viewport space: seq, x, y, w, h, fill_color. With compat only the last rectangle of a path is filled."""
    rows = lambda d, states, flat: (d.fills[0], [drawing.numbered(d.fills[0]), *d.fills[1:5], drawing.lists(d.fills[5:8])])
    return _folded(ops, pages, keys, "seq long, x double, y double, w double, h double, fill_color array<double>", "fills", rows, compat)


def image_meta(ops: DataFrame, pages: DataFrame | tuple, keys: list[str]) -> DataFrame:
    """Painted images in viewport space: seq, id, x, y, w, h, inline."""

    def rows(d: drawing.Drawing, states: dict, flat: drawing.Ops) -> tuple:
        page, which, kind = d.images[[0, 1, 6]].astype(np.int64)
        name = lambda p, k, kind: states[p].images[k][0] if kind == 3 else f"{('', 'mask_', 'inline_')[kind]}{k}" if kind else flat.image[k].as_py()
        inline = [kind in (1, 2) or (kind == 3 and states[p].images[k][5]) for p, k, kind in zip(page.tolist(), which.tolist(), kind.tolist(), strict=True)]
        return page, [drawing.numbered(page), [name(*x) for x in zip(page.tolist(), which.tolist(), kind.tolist(), strict=True)], *d.images[2:6], inline]

    return _folded(ops, pages, keys, "seq long, id string, x double, y double, w double, h double, inline boolean", "images", rows, True)


def drawn_segments(ops: DataFrame, pages: DataFrame | tuple, keys: list[str], eps: float = 4.0, compat: bool = True) -> DataFrame:
    """The segments of reconciled(subpaths(...)), in the pass that draws them: no path leaves its task."""
    names = pa.array(drawing.ORIGINS)

    def rows(d: drawing.Drawing, states, flat) -> tuple:
        page, origin, number, ends, width = drawing.reconciled(d, flat.vp, eps)
        return page, [names.take(pa.array(origin)), number, *ends, width]

    return _folded(ops, pages, keys, "origin string, id long, x1 double, y1 double, x2 double, y2 double, stroke_width double", "paths", rows, compat)


def classified(paths: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Subpaths with kind (RECT, POLYGON, ROUNDED_RECT, FREE_PATH), view (their segments in viewport space, ascending), and box corners l, t, r, b."""
    p = paths.join(pages.select(*keys, "vp"), keys).withColumn("_m", compose_affine(F.col("vp"), F.col("ctm")))

    def seen(s):
        x1, y1 = apply_affine(F.col("_m"), s[0], s[1])
        x2, y2 = apply_affine(F.col("_m"), s[2], s[3])
        return segments.normalised(x1, y1, x2, y2)

    p = p.withColumn("view", F.transform("segs", seen))
    level = F.forall("view", lambda s: ~((F.abs(s["x2"] - s["x1"]) > 0.5) & (F.abs(s["y2"] - s["y1"]) > 0.5)))
    n, curved = F.size("segs"), F.size("curves") > 0
    kind = F.when(level & ~curved & (n == 4), "RECT").when(level & ~curved & (n > 4), "POLYGON").when(level & curved & F.col("closed"), "ROUNDED_RECT").otherwise("FREE_PATH")
    ends = lambda a, b, f: f(F.concat(F.transform("view", lambda s: s[a]), F.transform("view", lambda s: s[b])))
    box = {"l": ends("x1", "x2", F.array_min), "r": ends("x1", "x2", F.array_max), "t": ends("y1", "y2", F.array_min), "b": ends("y1", "y2", F.array_max)}
    return p.withColumn("kind", kind).withColumns(box).drop("_m", "vp")


def reconciled(paths: DataFrame, pages: DataFrame, keys: list[str], eps: float = 4.0) -> DataFrame:
    """Segments of pages: keys, origin (rect, dash, path, diagonal), id, x1, y1, x2, y2, stroke_width.

    Rectangles give their edges, or one line if thin; single axis-parallel strokes merge into dash runs; polygons, rounded and free
    paths give their segments; a single slanted stroke stands as it is, and a short one vanishes.
    """
    c = cut(classified(paths, pages, keys))  # four branches read it; the fold over operators runs once
    rect = c.where("kind = 'RECT'").withColumns({"x": F.col("l"), "y": F.col("t"), "w": F.col("r") - F.col("l"), "h": F.col("b") - F.col("t")})
    out = segments.thin_rects(rect.select(*keys, "id", "stroke_width", "x", "y", "w", "h"), eps).select(*keys, F.lit("rect").alias("origin"), "id", "x1", "y1", "x2", "y2", "stroke_width")
    single = c.where("kind = 'FREE_PATH' and size(view) = 1").select(*keys, F.col("id").alias("seq"), "stroke_width", "stroke_color", F.col("view")[0].alias("v")).select(*keys, "seq", "stroke_width", "stroke_color", "v.*")
    runs = segments.dash_runs(single, keys, eps)
    flat = F.col("orient") == "H"
    pick = lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b))
    out = out.unionByName(runs.select(*keys, F.lit("dash").alias("origin"), F.col("run").alias("id"), pick("lo", "across").alias("x1"), pick("across", "lo").alias("y1"), pick("hi", "across").alias("x2"), pick("across", "hi").alias("y2"), (F.col("wide") / 2).alias("stroke_width")))
    slanted = single.where((F.abs(F.col("x2") - F.col("x1")) > eps) & (F.abs(F.col("y2") - F.col("y1")) > eps))
    out = out.unionByName(slanted.select(*keys, F.lit("diagonal").alias("origin"), F.col("seq").alias("id"), "x1", "y1", "x2", "y2", "stroke_width"))
    many = c.where("kind in ('ROUNDED_RECT', 'POLYGON') or (kind = 'FREE_PATH' and size(view) <> 1)").select(*keys, F.lit("path").alias("origin"), "id", "stroke_width", F.explode("view").alias("v"))
    return out.unionByName(many.select(*keys, "origin", "id", "v.x1", "v.y1", "v.x2", "v.y2", "stroke_width"))
