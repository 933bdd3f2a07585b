"""All detectors of a page in one pass over its packed items and segments.

What the DataFrame operators of scale, regions, lattice, streamtables and columns give one stage at a time is found here for each
page by itself, so that a plan has one shuffle of items and one of segments, whatever the number of detectors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import BULLET, ORDERED
from . import columns, segments
from .lattice import page_lattice
from .scale import LIMITS, OVERRIDABLE, RATIOS

#: White space by Unicode, as exprs.trimmed() takes it from both ends.
_EDGES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_DIGITS = re.compile(r"[0-9]{1,3}(?:\r\n|[\n\r\x85\u2028\u2029])?\Z")
_LISTED = re.compile(f"{BULLET}|{ORDERED}", re.ASCII)
#: Pages that are Python objects at a time.
SLICE = 128

ITEM, SEGMENT, BOX = ("idx", "str", "vx", "vy", "v_width", "v_font"), ("seq", *segments.ENDS), ("seq", "x", "y", "w", "h")
FOUND = {"id": "string", "type": "string", "x": "double", "y": "double", "w": "double", "h": "double", "font_size": "double", "confidence": "double", "column": "long", "text": "string", "sample": "string", "s": "double", "height": "double"}


def _half_up(x: float) -> int:
    return math.floor(x + 0.5) if math.isfinite(x) else 0 if x != x else int(math.copysign(2**63 - 1, x))


def _ordered(rows: Iterable[tuple], *places: int) -> list[tuple]:
    """Tuples by these places, nulls first."""
    rows = list(rows)
    try:
        return sorted(rows, key=itemgetter(*places))
    except TypeError:  # a null among values
        return sorted(rows, key=lambda i: [(i[p] is not None, i[p]) for p in places])


def _groups(values: list[float | None], tol: float, members: bool = False) -> list[int]:
    """folds.sorted_groups() of sorted values, by a running mean or by the mean of the members."""
    out, m, n, g = [], None, 0, -1
    for v in values:
        if n and m is not None and v is not None and abs((m / n if members else m) - v) <= tol:
            m = m + v if members else (m * n + v) / (n + 1)
            n += 1
        else:
            m, n, g = v, 1, g + 1
        out.append(g)
    return out


def _mean(values: list[float | None]) -> float | None:
    some = [v for v in values if v is not None]
    return sum(some) / len(some) if some else None


def _deviation(values: list[float]) -> float:
    """population_deviation(), by the updates that Spark makes."""
    if len(values) < 2:
        return 0.0
    n = mean = m2 = 0.0
    for v in values:
        n += 1
        d = v - mean
        mean += d / n
        m2 += d * (d - d / n)
    return math.sqrt(m2 / n)


def _scale(items: list[tuple]) -> float:
    """The most frequent font size in half-pixel bins, the bin seen first on ties."""
    sizes: dict[float, list[int]] = {}
    for i in items:  # by idx
        if i[6]:
            f = i[5] or 12.0
            if f in sizes:
                sizes[f][0] += 1
            else:
                sizes[f] = [1, -i[0]]
    bins: dict[float, tuple[int, int]] = {}
    for f, (n, first) in sizes.items():
        b = _half_up(f * 2) / 2
        bins[b] = (bins[b][0] + n, max(bins[b][1], first)) if b in bins else (n, first)
    return max(bins, key=bins.get) if bins else 12.0


def _flat(segs: list[tuple]) -> list[tuple]:
    """Horizontal segments: seq, y, left, right."""
    return [(q, (y1 + y2) / 2, min(x1, x2), max(x1, x2)) for q, x1, y1, x2, y2 in segs if abs(y2 - y1) <= 4 < abs(x2 - x1)]


def _underlines(flat: list[tuple], items: list[tuple]) -> set:
    out = set()
    text = [(x, y, w, x + w, f * RATIOS["r_underline"]) for _, _, x, y, w, f, t in items if t and None not in (x, y, w, f)]
    for q, hy, hl, hr in flat:
        for x, y, w, r, tol in text:
            if -1 <= hy - y <= tol and x <= hr + 2 and r >= hl - 2 and hr - hl < w * 1.2:
                out.add(q)
                break
    out.discard(None)
    return out


def _clusters(segs: list[tuple], axis: int, least_gap: float, share: float, least: int = 8) -> dict[int, list[tuple]]:
    """clusters.spatial_clusters() of one page, by number. axis: place of the first of two ends (1 for x, 2 for y)."""
    if len(segs) < 4:
        return {}
    mids = [None if s[axis] is None or s[axis + 2] is None else (s[axis] + s[axis + 2]) / 2 for s in segs]
    known = set(mids) - {None}
    cuts: list[float] = []
    if known and (spread := max(known) - min(known)) >= 50:
        limit = max(least_gap, spread * share)
        at = sorted({_half_up(c / 5) * 5.0 for c in known})
        cuts = [(b + a) / 2 for a, b in zip(at, at[1:], strict=False) if b - a > limit]
        if cuts and axis == 1:
            h = [(min(x1, x2), max(x1, x2)) for _, x1, y1, x2, y2 in segs if None not in (x1, y1, x2, y2) and abs(y2 - y1) <= 10 < abs(x2 - x1)]
            cuts = [c for c in cuts if sum(a < c < b for a, b in h) < 3]
    if not cuts:
        return {0: segs}
    out: dict[int, list[tuple]] = {}
    for s, c in zip(segs, mids, strict=True):
        if c is None or c not in cuts:
            out.setdefault(0 if c is None else sum(k < c for k in cuts), []).append(s)
    if max(map(len, out.values()), default=0) < least:
        return {0: [s for part in out.values() for s in part]} if out else {}
    return {k: part for k, part in out.items() if len(part) >= least}


def _grid(segs: list[tuple], eps: float = 5.0) -> tuple | None:
    """page_lattice() of segments."""
    h, v = [], []
    for _, x1, y1, x2, y2 in segs:
        try:
            across, along = abs(x2 - x1), abs(y2 - y1)
        except TypeError:  # a null
            continue
        if along <= eps < across:
            h.append((y1, x1, x2) if x1 <= x2 else (y1, x2, x1))
        elif across <= eps < along:
            v.append((x1, y1, y2) if y1 <= y2 else (x1, y2, y1))
    return page_lattice(sorted(h), sorted(v), eps) if len(h) > 1 and len(v) > 1 else None


def _grids(segs: list[tuple], s: float) -> list[tuple]:
    """(id, column lines, x, y, w, h) of the grids of lattice.table_lattices()."""
    parts = [(a, b, part) for a, rows in _clusters(segs, 2, s * RATIOS["r_cluster_y_gap"], 0.10).items() for b, part in _clusters(rows, 1, s * RATIOS["r_cluster_x_gap"], 0.08).items()]
    found = [(a, b, g) for a, b, part in parts if (g := _grid(part))]
    if not found and not (len(parts) == 1 and len(parts[0][2]) == len(segs)) and (g := _grid(segs)):
        found = [(-1, -1, g)]
    return [(f"l_{a}_{b}", len(cols), cols[0], rows[0], cols[-1] - cols[0], rows[-1] - rows[0]) for a, b, (rows, cols, *_) in found]


def _inside(i: tuple, x: float, y: float, w: float, h: float, pad: float) -> bool:
    return i[2] is not None and i[3] is not None and x - pad <= i[2] <= x + w + pad and y - pad <= i[3] <= y + h + pad


def _claimed(items: list[tuple], boxes: list[tuple], pad: float) -> dict[int, str]:
    """idx of the items in a box (id, x, y, w, h), widened by pad, with the first such id."""
    out: dict[int, str] = {}
    for k, *box in boxes:
        for i in items:
            if _inside(i, *box, pad) and (i[0] not in out or k < out[i[0]]):
                out[i[0]] = k
    return out


def _taken(items: list[tuple], claims: dict[int, str]) -> tuple[dict[str, tuple], list[tuple]]:
    """By id the mean font and the joined text of the claimed items; and the items left."""
    held: dict[str, list[tuple]] = {}
    for i in items:
        if i[0] in claims:
            held.setdefault(claims[i[0]], []).append(i)
    texts = {k: (_mean([i[5] for i in mine]), " ".join(i[1] for i in _ordered(mine, 3, 2, 0) if i[1] is not None)) for k, mine in held.items()}
    return texts, [i for i in items if i[0] not in claims] if claims else items


def _tables(items: list[tuple], s: float, band_tol: float, col_tol: float, least: float) -> list[tuple]:
    """(id, x, y, w, h, confidence) of the accepted sections of streamtables.candidates()."""
    text = _ordered((i for i in items if i[6]), 3, 0)
    if len(text) < 6:
        return []
    band = _groups([i[3] for i in text], band_tol)
    means: list[list] = []
    for b, i in zip(band, text, strict=True):
        if b == len(means):
            means.append([i[3], 1])
        else:
            m, n = means[b]
            means[b] = [(m * n + i[3]) / (n + 1), n + 1]
    y = [m for m, _ in means]
    if len(y) < LIMITS["stream_min_bands"]:
        return []
    gaps = [None if a is None or b is None else b - a for a, b in zip(y, y[1:], strict=False)]
    known = sorted(g for g in gaps if g is not None)
    limit = max(known[len(known) // 2] * 2.5, 20.0) if known else 20.0
    section, number = [0], 0
    for g in gaps:
        number += g is None or g > limit
        section.append(number)
    sizes = np.bincount(section).tolist()
    if max(sizes) < LIMITS["stream_min_bands"]:
        section, sizes = [0] * len(section), [LIMITS["stream_min_bands"]]
    out = []
    for k, size in enumerate(sizes):
        if size < LIMITS["stream_min_bands"]:
            continue
        mine = _ordered(((i[2], b, i[0], i) for b, i in zip(band, text, strict=True) if section[b] == k), 0, 1, 2)
        parts: dict[int, list] = {}
        for g, m in zip(_groups([m[0] for m in mine], col_tol, True), mine, strict=True):
            parts.setdefault(g, []).append(m)
        edge = [(_mean(xs), _deviation(xs)) for part in parts.values() if len({m[1] for m in part}) >= 2 and None not in (xs := [m[0] for m in part])]
        if len(edge) < LIMITS["stream_min_cols"]:
            continue
        anchors, spread = sorted(e[0] for e in edge), sum(e[1] for e in edge) / len(edge)
        near = sorted({m[1] for m in mine if m[0] is not None and any(abs(m[0] - a) <= col_tol for a in anchors)})
        rows = sorted(y[b] for b in near if y[b] is not None)
        if not rows:
            continue
        steps = [b - a for a, b in zip(rows, rows[1:], strict=False)]
        aligned = max(0.0, 1 - spread / col_tol) if col_tol else float(not spread)
        regular = 0.8 if len(steps) < 2 else max(0.0, 1 - _deviation(steps) / (_mean(steps) or 1.0))
        confidence, n = (aligned + regular) / 2, len(mine)
        if n / (len(rows) * len(edge)) < LIMITS["stream_min_fill"] or sum(len(m[3][6]) for m in mine) / n > LIMITS["stream_max_avg_len"] or n / len(rows) > LIMITS["stream_max_items_band"] or not confidence >= least:
            continue
        x, top = anchors[0] - col_tol * 0.5, rows[0] - s * 0.6
        ends = [m[0] + m[3][4] for m in mine if None not in (m[0], m[3][4])]
        right = max([anchors[-1] + col_tol * 0.5] + [max(ends) + s * 0.3] * bool(ends))
        out.append((f"s{k}", x, top, right - x, rows[-1] + s * 0.6 - top, confidence))
    return out


def _covered(box: tuple, others: list[tuple], share: float = 0.8) -> bool:
    x, y, w, h = box
    area = w * h
    for ox, oy, ow, oh in others:
        iw, ih = min(x + w, ox + ow) - max(x, ox), min(y + h, oy + oh) - max(y, oy)
        if area > 0 and iw > 0 and ih > 0 and iw * ih / area >= share:
            return True
    return False


def _frames(segs: list[tuple], items: list[tuple], width: float | None, pad: float, eps: float = 10.8) -> list[tuple]:
    """(seq, x, y, w, h, items) of regions.boxes()."""
    text = [i for i in items if i[6]]
    if not text or width is None:
        return []
    flat = sorted(f for f in _flat(segs) if f[0] is not None)
    walls = [((x1 + x2) / 2, min(y1, y2), max(y1, y2)) for _, x1, y1, x2, y2 in segs if abs(x2 - x1) <= 4 < abs(y2 - y1)]
    out, done, claimed = [], None, set()
    for k, (q, y, left, right) in enumerate(flat):
        found = []
        for q2, y2, left2, right2 in flat[k + 1 :]:
            if q2 == q or abs(left - left2) > eps or abs(right - right2) > eps or abs(y - y2) < 20.0:
                continue
            x1, x2, top, low = (left + left2) / 2, (right + right2) / 2, min(y, y2), max(y, y2)
            if all(any(abs(v - side) <= eps and t <= top + eps and b >= low - eps for v, t, b in walls) for side in (x1, x2)):
                found.append((q, q2, x1, top, x2 - x1, low - top))
        for _, _, x, top, w, h in sorted(found):
            if q == done:
                break
            if (x < width * 0.04 and w > width * 0.65) or w > width * 0.88:
                continue
            free = [i for i in text if i[0] not in claimed and _inside(i, x, top, w, h, pad)]
            if max((i[4] for i in free if i[4] is not None), default=-math.inf) >= w * 0.25:
                done = q
                claimed.update(i[0] for i in free)
                out.append((q, x, top, w, h, free))
    return out


def _splits(items: list[tuple], band: list[int], width: float, s: float, gap: float) -> list[float]:
    """Column splits of banded items. A split has three bands at least on either side."""
    some = sorted(((i[2], i[2] + (i[4] or 0.0), b, i[3], bool(i[1] is not None and _DIGITS.match(i[1].strip(" ")))) for b, i in zip(band, items, strict=True) if None not in (i[2], i[3])))
    if not some or width is None or (len({r[2] for r in some}) < 2 * columns.LEAST_SIDE and all(r[1] >= r[0] for r in some)):
        return []
    lo, hi, of, vy, digits = (np.array(c) for c in zip(*some, strict=True))
    _, which = np.unique(of, return_inverse=True)
    n = which.max() + 1
    low, high, y = np.full(n, np.inf), np.full(n, -np.inf), np.bincount(which, vy) / np.bincount(which)
    np.minimum.at(low, which, lo)
    np.maximum.at(high, which, hi)
    return columns.find_splits(columns.Bands(y, low, high), lo, hi, digits, width, s, gap)


def _extent(mine: list[tuple]) -> tuple:
    """x_min, x_max, y_min and y_max of items; null without known places."""
    xs, ends, ys = [i[2] for i in mine if i[2] is not None], [i[2] + i[4] for i in mine if None not in (i[2], i[4])], [i[3] for i in mine if i[3] is not None]
    return min(xs, default=None), max(ends, default=None), min(ys, default=None), max(ys, default=None)


def _blocks(items: list[tuple], s: float, band_tol: float, skip: tuple[str, ...]) -> list[tuple]:
    """(block, type, x, y, w, h, font, text) of one column's items."""
    items = _ordered(items, 3, 0)
    lines: list[list[tuple]] = []
    for g, i in zip(_groups([i[3] for i in items], band_tol), items, strict=True):
        if g == len(lines):
            lines.append([])
        lines[g].append(i)
    rows = []
    for mine in lines:
        text = " ".join(i[6] for i in _ordered(mine, 2, 0) if i[6] is not None)
        plain, font = text.strip(_EDGES), _mean([i[5] for i in mine])
        large = font is not None and font > s * LIMITS["heading_scale"] and not (len(mine) == 1 and len(plain) <= 2)
        kind = None if plain == "" else "HEADING" if large else "LIST" if _LISTED.search(plain) else "PARAGRAPH"
        rows.append((_extent(mine), text, font, len(mine), "PARAGRAPH" if kind in ("HEADING", "LIST") and kind in skip else kind))
    runs: list[list[tuple]] = []
    for k, row in enumerate(rows):
        if row[4] is None:
            continue
        now, before = row[0][2], rows[k - 1][0][2] if k else None
        far = now is None or before is None or now - before > s * RATIOS["r_para_gap"]
        if not runs or runs[-1][-1][4] != row[4] or far:
            runs.append([])
        runs[-1].append(row)
    out = []
    for k, run in enumerate(runs):
        if run[0][4] in skip:
            continue
        (x, r, y, b), n = (pick([v for v in (line[0][c] for line in run) if v is not None], default=None) for c, pick in enumerate((min, max, min, max))), sum(line[3] for line in run)
        total = [line[2] * line[3] for line in run if line[2] is not None]
        font = sum(total) / n if total else None
        w, h = None if None in (r, x) else r - x, None if None in (b, y, font) else b - y + font
        held = [] if h is None else sorted((line[0][2], line[1]) for line in rows if line[0][2] is not None and y <= line[0][2] <= y + h)
        out.append((k, run[0][4], x, y, w, h, font, " ".join(t for _, t in held) if held else None))
    return out


def page_regions(items: list[tuple], segs: list[tuple], images: list[tuple] | None, width: float | None, height: float | None, own: dict[str, float], skip: tuple[str, ...]) -> list[tuple]:
    """Regions (FOUND) of one page. items (ITEM), segs (SEGMENT), images: boxes (x, y, w, h), if any are looked for; own: ratios of the page in place of the fixed ones."""
    items = _ordered([(*i, None if i[1] is None else i[1].strip(_EDGES)) for i in items], 0)
    s = _scale(items)
    band_tol, pad = s * own["r_y_band"], max(2.0, s * RATIOS["r_table_pad"])
    whole = segs if all(None not in i for i in segs) else [i for i in segs if None not in i[1:]]
    flat = _flat(whole)
    under = _underlines(flat, items)
    ruling = [i for i in segs if i[0] not in under] if under else segs
    clear = ruling if len(whole) == len(segs) else [i for i in ruling if None not in i[1:]]
    it, out, others = items, [], images

    def add(kind: str, k: str, x, y, w, h, font=None, confidence=None, column=None, text=None, sample=None) -> None:  # noqa: ANN001
        out.append((k, kind, x, y, w, h, font, confidence, column, text, sample, s, height))

    if "LATTICE_TABLE" not in skip:
        grids = _grids(ruling, s)
        narrow = []
        for box in sorted({g[2:] for g in grids if g[1] <= 2}, key=lambda b: (b[1], b[0], b[2], b[3])):
            held = [i for i in it if i[6] and _inside(i, *box, pad)]
            if max((i[4] for i in held if i[4] is not None), default=-math.inf) >= box[2] * 0.30:
                first = " ".join(i[1] for i in _ordered(held, 3, 2, 0)[:8])
                narrow.append((f"n{len(narrow)}", box, held, first.strip(" ")[:60]))
        claims: dict[int, str] = {}
        for k, _, held, _ in narrow:
            for i in held:
                claims[i[0]] = min(k, claims.get(i[0], k))
        texts, it = _taken(it, claims)
        for k, box, _, sample in narrow:
            font, text = texts.get(k, (None, None))
            add("BOX", k, *box, font, text=text, sample=sample)
        tables = [(k, *box) for k, n, *box in grids if n > 2]
        texts, it = _taken(it, _claimed(it, tables, pad))
        for k, *box in tables:
            font, text = texts.get(k, (None, None))
            add("LATTICE_TABLE", k, *box, font, text=text)
        others = [t[1:] for t in tables]
    if "STREAM_TABLE" not in skip:
        found = [t for t in _tables(it, s, band_tol, s * RATIOS["r_col_tol"], own["stream_confidence"]) if not others or not _covered(t[1:5], others)]
        texts, it = _taken(it, _claimed(it, [t[:5] for t in found], pad))
        for *box, confidence in found:
            font, text = texts.get(box[0], (None, None))
            add("STREAM_TABLE", *box, font, confidence, text=text)
    if "BOX" not in skip:
        framed = _frames(clear, it, width, pad)
        texts, it = _taken(it, {i[0]: f"b{q}" for q, *_, held in framed for i in held})
        for q, *box, held in framed:
            font, text = texts.get(f"b{q}", (None, None))
            add("BOX", f"b{q}", *box, font, text=text, sample=" ".join(i[1] for i in held[:8]))
    if it:
        ordered = _ordered(it, 3, 0)
        splits = _splits(ordered, _groups([i[3] for i in ordered], band_tol), width, s, s * own["r_col_gap_min"])
        parts: dict[int, list[tuple]] = {}
        for i in it:
            parts.setdefault(0 if i[2] is None else sum(x <= i[2] for x in splits), []).append(i)
        for column, k in enumerate(sorted(parts)):
            for block, kind, *box, font, text in _blocks(parts[k], s, band_tol, skip):
                add(kind, f"t{column}_{block}", *box, font, column=column, text=text)
    if "DIVIDER" not in skip and width is not None:
        boxes = [b for b in [*(images or []), *(r[2:6] for r in out)] if None not in b]
        for q, my, left, right in flat:
            if right - left < width * 0.15 or q in under:
                continue
            mx = (left + right) / 2
            if any(x - 5 <= mx <= x + w + 5 and y - 5 <= my <= y + h + 5 for x, y, w, h in boxes):
                continue
            if any(None not in (i[2], i[3], i[4]) and abs(i[3] - my) < s * 0.8 and i[2] < right + 4 and i[2] + i[4] > left - 4 for i in items):
                continue
            add("DIVIDER", None if q is None else f"d{q}", left, my - 1, right - left, 2.0)
    return out


def _column(c: pa.Array) -> list:
    return c.to_pylist() if c.null_count or not pa.types.is_primitive(c.type) or pa.types.is_boolean(c.type) else c.to_numpy(zero_copy_only=False).tolist()


def _rows(c: pa.Array) -> list[list[tuple] | None]:
    """The structs of each list of a list column, as tuples."""
    flat = c.flatten()
    rows = list(zip(*[_column(f) for f in flat.flatten()], strict=True))
    ends = np.cumsum([0, *(n or 0 for n in c.value_lengths().to_pylist())]).tolist()
    return [rows[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def found(items: DataFrame, segs: DataFrame, images: DataFrame | None, pages: DataFrame, keys: list[str], overrides: DataFrame | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """Regions (keys, FOUND) of all pages that have items; images: boxes with seq. sample is the text that tells a box's role; s and height are the page's."""
    types = {"idx": "long", "str": "string", "seq": "long"}
    pack = lambda df, names, as_: df.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c).cast(types.get(c, "double")).alias(c) for c in names])).alias(as_))
    given = pages.select(*keys, F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    fixed = {**RATIOS, "stream_confidence": LIMITS["stream_confidence"]}
    if overrides is not None:
        given = given.join(overrides.select(*keys, *OVERRIDABLE), keys, "left")
    given = given.select(*keys, "width", "height", *[F.coalesce(F.col(n).cast("double"), F.lit(fixed[n])).alias(n) if overrides is not None else F.lit(fixed[n]).alias(n) for n in OVERRIDABLE])
    packed = given.join(pack(items, ITEM, "_items"), keys).join(pack(segs, SEGMENT, "_segs"), keys, "left")
    packed = packed.join(pack(images, BOX, "_images"), keys, "left") if images is not None else packed.withColumn("_images", F.lit(None).cast("array<struct<seq:bigint,x:double,y:double,w:double,h:double>>"))
    kinds = {f.name: f.dataType for f in packed.schema.fields}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in keys] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in FOUND.items()])
    arrow = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    n, looked, names = len(keys), images is not None, [*keys, *FOUND]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                col = lambda name: part.column(part.schema.get_field_index(name))  # noqa: B023, E731
                own = [dict(zip(OVERRIDABLE, v, strict=True)) for v in zip(*[_column(col(c)) for c in OVERRIDABLE], strict=True)]
                got, where = [], []
                for k, (i, g, m, width, height, o) in enumerate(zip(_rows(col("_items")), _rows(col("_segs")), _rows(col("_images")), _column(col("width")), _column(col("height")), own, strict=True)):
                    rows = page_regions(i, g, [b[1:] for b in m] if looked else None, width, height, o, skip)
                    got += rows
                    where += [k] * len(rows)
                if got:
                    at = pa.array(where, pa.int64())
                    yield pa.RecordBatch.from_arrays([*[part.column(c).take(at) for c in range(n)], *[pa.array(v, arrow[t]) for v, t in zip(zip(*got, strict=True), FOUND.values(), strict=True)]], names=names)

    return packed.select(*keys, "width", "height", *OVERRIDABLE, "_items", "_segs", "_images").mapInArrow(run, schema)
