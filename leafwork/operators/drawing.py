"""Drawing operators of many pages at once, as columns: the n-th operators of all pages are taken together.

States don't commute, so the operators of one page are taken one after another, but pages don't see each other: a step is
a few numpy calls for thousands of pages, with the numbers that ``paths.PageState`` gets page by page.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Operators by what they do.
FILLS = {"fill", "eoFill", "fillStroke", "eoFillStroke", "closeFillStroke", "closeEOFillStroke"}
STROKES = {"stroke", "closeStrokePath"}
SIZES = {"moveTo": 2, "lineTo": 2, "rectangle": 4, "curveTo": 6, "curveTo2": 4, "curveTo3": 4, "closePath": 0}
#: Arguments of the operators that may stand in a run.
ARGS = SIZES | {"save": 0, "restore": 0, "transform": 6, "setLineWidth": 1} | dict.fromkeys(FILLS | STROKES, 0) | {f"set{kind}{space}": n for kind in ("Fill", "Stroke") for space, n in (("Gray", 1), ("RGBColor", 3), ("CMYKColor", 4))}

#: Fewer pages than this go one by one: a step for them costs more than they do.
FEW = 32
#: Rows of the paths of a drawing.
PATH = ("page", "id", "closed", "filled", "width", "s0", "s1", "s2", "f0", "f1", "f2", "batch", "m0", "m1", "m2", "m3", "m4", "m5", "n_segs", "n_curves")


class Ops(NamedTuple):
    """Operators of whole pages in order: codes (places in names), arguments (values from at on, n of them), batch (of constructPath, else -1)."""

    names: list[str]
    code: np.ndarray
    at: np.ndarray
    n: np.ndarray
    values: np.ndarray
    batch: np.ndarray | None
    image: pa.Array | None
    first: np.ndarray
    size: np.ndarray
    vp: np.ndarray

    def args(self, o: int) -> list[float]:
        return self.values[self.at[o] : self.at[o] + self.n[o]].tolist()


class Drawing(NamedTuple):
    """What pages have drawn, a column each: fills (page, box, colour), images (page, operator, box, kind), paths by PATH in order, and their segments and curves on end."""

    fills: np.ndarray
    images: np.ndarray
    paths: np.ndarray
    segs: np.ndarray
    curves: np.ndarray


def joined(parts: list[Drawing]) -> Drawing:
    return parts[0] if len(parts) == 1 else Drawing(*[np.concatenate(x, axis=1) for x in zip(*parts, strict=True)])


def _coded(column: pa.Array, names: list[str]) -> np.ndarray:
    """Strings as places in names, which grows; null is -1."""
    coded = column.dictionary_encode()
    place = []
    for name in coded.dictionary.to_pylist():
        if name not in names:
            names.append(name)
        place.append(names.index(name))
    return np.array([*place, -1], dtype=np.int32)[coded.indices.fill_null(len(place)).to_numpy(zero_copy_only=False)]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat(rows: dict[str, pa.Array], starts: np.ndarray, vp: np.ndarray) -> Ops:
    """Operators from rows of fn and args (and sub_ops, sub_args, image_id); starts: each page's first row.

    A row whose fn has several names with blanks between is a run: its args are those of its operators on end, as many as ARGS says.
    """
    coded, given = rows["fn"].dictionary_encode(), rows["args"]
    run, have = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False), _lengths(given)
    runs = [*[r.split(" ") for r in coded.dictionary.to_pylist()], [None]]
    names = list(dict.fromkeys(f for r in runs for f in r if f is not None))
    if unknown := {f for r in runs if len(r) > 1 for f in r} - ARGS.keys():
        raise ValueError(f"in a run of operators: {sorted(unknown)}")
    long = np.array([len(r) for r in runs])
    table = np.array([-1 if f is None else names.index(f) for r in runs for f in r], np.int32)
    needs = np.array([ARGS.get(f, 0) for r in runs for f in r])
    n_ops = long[run]
    ends = np.cumsum(n_ops)
    place = np.arange(ends[-1]) + np.repeat((np.cumsum(long) - long)[run] - ends + n_ops, n_ops)
    code, n = table[place], needs[place]
    one = n_ops == 1
    n[ends[one] - 1] = have[one]
    if (np.add.reduceat(needs, np.cumsum(long) - long)[run] != have)[~one].any():
        raise ValueError("a run of operators has not the arguments it needs")
    values, first = _numbers(given.flatten()), (ends - n_ops)[starts]
    at, size, batch, image = np.cumsum(n) - n, np.diff(np.append(first, len(code))), None, rows.get("image_id")
    if image is not None and not one.all():
        image = image.take(pa.array(np.repeat(np.arange(len(n_ops)), n_ops)))
    if "constructPath" in names:
        sets = code == names.index("constructPath")
        subs, given = (rows[k].filter(pa.array(sets[ends - 1])) for k in ("sub_ops", "sub_args"))
        sub_code, sub_n, have = _coded(subs.flatten(), names), _lengths(subs), _lengths(given)
        sub_size = np.array([SIZES.get(name, -1) for name in names])[sub_code]
        used = np.bincount(np.repeat(np.arange(len(sub_n)), sub_n), weights=sub_size, minlength=len(sub_n))
        if (sub_size < 0).any() or (used > have).any():
            raise ValueError("constructPath: an unknown operator, or too few arguments")
        begun = np.cumsum(sub_size) - sub_size
        within = begun - np.repeat(np.concatenate([begun, [0]])[np.minimum(np.cumsum(sub_n) - sub_n, len(begun))], sub_n)
        sub_at = len(values) + np.repeat(np.cumsum(have) - have, sub_n) + within
        values = np.concatenate([values, _numbers(given.flatten())])
        times = np.ones(len(code), np.int64)
        times[sets] = sub_n
        inside = np.repeat(sets, times)
        before = np.concatenate([[0], np.cumsum(sets)])
        number = np.repeat(before[:-1] - np.repeat(before[first], size), times)
        source = np.repeat(np.arange(len(code)), times)
        put = lambda old, new: (out := old[source], out.__setitem__(inside, new))[0]
        first = np.concatenate([[0], np.cumsum(times)])[first]
        code, at, n, batch = put(code, sub_code), put(at, sub_at), put(n, sub_size), np.where(inside, number, -1)
        size, image = np.diff(np.append(first, len(code))), image and image.take(pa.array(source))
    return Ops(names, code, at, n, values, batch, image, first, size, vp)


def apart(ops: Ops) -> np.ndarray:
    """Whether each page must go by itself: it is longer than all but FEW pages, or an operator is null or has not the arguments it needs."""
    if len(ops.size) <= FEW:
        return np.ones(len(ops.size), bool)
    alone = ops.size > np.partition(ops.size, -FEW - 1)[-FEW - 1]
    least = np.array([SIZES.get(f, 6 if f == "transform" else 1 if f == "setLineWidth" or "Gray" in f else 4 if "CMYK" in f else 0) for f in ops.names] + [0])
    wrong = (ops.n < least[ops.code]) | (ops.code < 0)
    for f in ("rectangle", "curveTo", "curveTo2", "curveTo3"):
        if f in ops.names:
            wrong |= (ops.code == ops.names.index(f)) & (ops.n != SIZES[f])
    if wrong.any():
        alone[np.searchsorted(ops.first, np.flatnonzero(wrong), side="right") - 1] = True
    return alone


def drawn(ops: Ops, pages: np.ndarray, want: str) -> Drawing:
    """The drawing of these pages (places in ops.first), in step. want: fills, images or paths; the others stay empty.

    The rules are those of ``paths.PageState`` with compat: one pending rectangle, stale starts.
    """
    pages = pages[np.argsort(-ops.size[pages], kind="stable")]
    size, first, vp, names = ops.size[pages], ops.first[pages], ops.vp[:, pages], ops.names
    n_pages, per = len(pages), np.bincount(ops.code[ops.code >= 0], minlength=len(names))
    count = lambda *fns: int(sum(per[names.index(f)] for f in fns if f in names))
    track = want == "paths"
    ctm = np.repeat(np.array(IDENTITY)[:, None], n_pages, axis=1)
    width, fill, stroke = np.ones(n_pages), np.zeros((3, n_pages)), np.zeros((3, n_pages))
    here, start = np.zeros((2, n_pages)), np.zeros((2, n_pages))
    pending, pends, n_images, made = np.zeros((7, n_pages)), np.zeros(n_pages, bool), np.zeros(n_pages, np.int64), np.zeros(n_pages, np.int64)
    saved, below, top, n_saved = np.empty((12, count("save"))), np.empty(count("save"), np.int64), np.full(n_pages, -1), 0
    each, cur = np.arange(n_pages), np.arange(n_pages)
    fills, images = [np.empty((8, 0))], [np.empty((7, 0))]
    room = (n_pages + count("moveTo", "rectangle"), count("lineTo", "closePath") + 4 * count("rectangle"), count("curveTo", "curveTo2", "curveTo3")) if track else (0, 0, 0)
    path, seg, seg_of, curve, curve_of = np.zeros((18, room[0])), np.empty((4, room[1])), np.empty(room[1], np.int64), np.empty((8, room[2])), np.empty(room[2], np.int64)
    n_paths = n_segs = n_curves = 0

    def opened(i, o) -> None:
        nonlocal n_paths
        if track:
            who = each[i]
            new = slice(n_paths, n_paths + len(who))
            path[0, new], path[1, new], path[4, new], path[5:8, new], path[8:11, new] = pages[who], made[i], width[i], stroke[:, i], fill[:, i]
            path[11, new] = -1 if o is None or ops.batch is None else ops.batch[o]
            path[12:18, new] = ctm[:, i]
            cur[i] = np.arange(n_paths, n_paths + len(who))
            made[i] += 1
            n_paths += len(who)

    def lined(i, *ends) -> None:
        nonlocal n_segs
        if track:
            whose = cur[i]
            new = slice(n_segs, n_segs + len(whose))
            for k, v in enumerate(ends):
                seg[k, new] = v
            seg_of[new] = whose
            n_segs += len(whose)

    def box(i, x, y, x2, y2) -> tuple:
        for m in (ctm, vp):
            a, b, c, d, e, f = (row[i] for row in m)
            x, y, x2, y2 = a * x + c * y + e, b * x + d * y + f, a * x2 + c * y2 + e, b * x2 + d * y2 + f
        return np.minimum(x, x2), np.minimum(y, y2), np.abs(x2 - x), np.abs(y2 - y)

    def color(fn: str, i, o, a, old: np.ndarray) -> None:
        if "CMYK" in fn:
            old[:, i] = np.stack([(1 - a(k)) * (1 - a(3)) for k in range(3)])
            return
        n, who = ops.n[o], each[i]
        gray = np.full(len(o), True) if "Gray" in fn else n == 1
        of = ops.at[o]
        for k in range(3):
            old[k, who[gray]] = ops.values[of[gray]]
            old[k, who[~gray & (n >= 3)]] = ops.values[of[~gray & (n >= 3)] + k]

    opened(slice(0, n_pages), None)
    lives = np.searchsorted(-size, -np.arange(size[0] if n_pages else 0), side="left")
    for t, live in enumerate(lives.tolist()):
        at_step = first[:live] + t
        c = ops.code[at_step]
        if c[0] == c[-1] and (c == c[0]).all():
            groups = [(names[c[0]], slice(0, live), at_step)]
        else:
            groups = [(names[k], i := np.flatnonzero(c == k), at_step[i]) for k in np.flatnonzero(np.bincount(c))]
        for fn, i, o in groups:
            a = lambda k, of=ops.at[o]: ops.values[of + k]
            if fn == "rectangle":
                x, y, w, h = a(0), a(1), a(2), a(3)
                r, b = x + w, y + h
                if track:
                    opened(i, o)
                    for ends in ((x, y, r, y), (r, y, r, b), (r, b, x, b), (x, b, x, y)):
                        lined(i, *ends)
                    here[0, i], here[1, i] = x, y
                elif want == "fills":
                    pending[0, i], pending[1, i], pending[2, i], pending[3, i] = box(i, x, y, r, b)
                    pending[4:, i] = fill[:, i]
                    pends[i] = True
            elif fn in SIZES:
                if not track:
                    continue
                if fn == "moveTo":
                    opened(i, o)
                    here[0, i], here[1, i] = start[0, i], start[1, i] = a(0), a(1)
                elif fn == "lineTo":
                    x, y = a(0), a(1)
                    lined(i, here[0, i], here[1, i], x, y)
                    here[0, i], here[1, i] = x, y
                elif fn == "closePath":
                    lined(i, *here[:, i], *start[:, i])
                    here[:, i] = start[:, i]
                    path[2, cur[i]] = 1
                else:
                    given = [a(k) for k in range(SIZES[fn])]
                    old = [here[0, i], here[1, i]]
                    points = {"curveTo": given, "curveTo2": [*old, *given], "curveTo3": [*given, *given[-2:]]}[fn]
                    new = slice(n_curves, n_curves + len(o))
                    for k, v in enumerate([*old, *points]):
                        curve[k, new] = v
                    curve_of[new] = cur[i]
                    n_curves += len(o)
                    here[0, i], here[1, i] = points[-2:]
            elif fn == "save":
                new = slice(n_saved, n_saved + len(o))
                saved[:6, new], saved[6:9, new], saved[9:, new], below[new] = ctm[:, i], fill[:, i], stroke[:, i], top[i]
                top[i] = np.arange(n_saved, n_saved + len(o))
                n_saved += len(o)
            elif fn == "restore":
                of = top[i]
                if (of >= 0).all():
                    who = i
                else:
                    ctm[:, each[i][of < 0]] = np.array(IDENTITY)[:, None]
                    who, of = each[i][of >= 0], of[of >= 0]
                ctm[:, who], fill[:, who], stroke[:, who], top[who] = saved[:6, of], saved[6:9, of], saved[9:, of], below[of]
            elif fn == "transform":
                m, b = [ctm[k, i].copy() for k in range(6)], [a(k) for k in range(6)]
                ctm[0, i], ctm[1, i], ctm[2, i] = m[0] * b[0] + m[2] * b[1], m[1] * b[0] + m[3] * b[1], m[0] * b[2] + m[2] * b[3]
                ctm[3, i], ctm[4, i], ctm[5, i] = m[1] * b[2] + m[3] * b[3], m[0] * b[4] + m[2] * b[5] + m[4], m[1] * b[4] + m[3] * b[5] + m[5]
            elif fn == "setLineWidth":
                width[i] = a(0)
            elif fn.startswith("setFill"):
                color(fn, i, o, a, fill)
            elif fn.startswith("setStroke"):
                color(fn, i, o, a, stroke)
            elif fn in FILLS:
                if track:
                    path[3, cur[i]] = 1
                has = pends[i]
                who = i if has.all() else each[i][has]
                if want == "fills" and has.any():
                    fills.append(np.concatenate([pages[each[who]][None].astype(np.float64), pending[:, who]]))
                pends[i] = False
            elif fn in STROKES:
                pends[i] = False
            elif fn.startswith("paint") and want == "images":
                x, y, w, h = box(i, *np.zeros((2, len(o))), *np.ones((2, len(o))))
                own = "Mask" in fn or "Inline" in fn
                shown = (w > 8) & (h > 8) if own else ops.image.take(pa.array(o)).is_valid().to_numpy(zero_copy_only=False) if ops.image is not None else np.zeros(len(o), bool)
                who = each[i][shown]
                kind = np.full(len(who), 1 if "Mask" in fn else 2 if own else 0)
                images.append(np.stack([pages[who], n_images[who] if own else o[shown], x[shown], y[shown], w[shown], h[shown], kind]))
                n_images[who] += 1
    by_page = lambda blocks: (x := np.concatenate(blocks, axis=1))[:, np.argsort(x[0], kind="stable")]
    n_seg, n_curve = np.bincount(seg_of[:n_segs], minlength=n_paths), np.bincount(curve_of[:n_curves], minlength=n_paths)
    found = np.concatenate([path[:, :n_paths], n_seg[None], n_curve[None]])
    order = np.lexsort((found[1], found[0]))
    rank = np.empty(n_paths, np.int64)
    rank[order] = np.arange(n_paths)
    found = found[:, order]
    listed = lambda v, of: v[:, np.argsort(rank[of], kind="stable")]
    return Drawing(by_page(fills), by_page(images), found[:, found[18] + found[19] > 0], listed(seg[:, :n_segs], seg_of[:n_segs]), listed(curve[:, :n_curves], curve_of[:n_curves]))


def of_state(state, page: int) -> Drawing:
    """The drawing of one page from its finished ``paths.PageState``; an image's operator stands as its place in state.images."""
    block = lambda rows, n: np.array(rows, np.float64).reshape(-1, n).T
    fills = [(page, *f[:4], *f[4]) for f in state.fills]
    images = [(page, k, *m[1:5], 3) for k, m in enumerate(state.images)]
    rows = [(page, p["id"], p["closed"], p["filled"], p["stroke_width"], *p["stroke_color"], *p["fill_color"], -1 if p["construct_path_id"] is None else p["construct_path_id"], *p["ctm"], len(p["segs"]), len(p["curves"])) for p in state.paths]
    return Drawing(block(fills, 8), block(images, 7), block(rows, len(PATH)), block([s for p in state.paths for s in p["segs"]], 4), block([c for p in state.paths for c in p["curves"]], 8))


def lists(columns: np.ndarray) -> pa.Array:
    """Columns of numbers as one list a row."""
    width, n = columns.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(np.ascontiguousarray(columns.T).ravel()))


def numbered(pages: np.ndarray) -> np.ndarray:
    """The place of each row among those of its page; a page's rows stand together."""
    begins = np.flatnonzero(np.append(True, pages[1:] != pages[:-1])) if len(pages) else np.zeros(0, np.int64)
    return np.arange(len(pages)) - np.repeat(begins, np.diff(np.append(begins, len(pages))))


def _dashes(page, view, width, color, eps) -> tuple:
    """Runs of single strokes, as ``segments.dash_runs`` has them: page, run, ends, width."""
    x1, y1, x2, y2 = view
    dx, dy = np.abs(x2 - x1), np.abs(y2 - y1)
    flat_, tall = (dy <= eps) & (dx > eps), (dx <= eps) & (dy > eps)
    seq = np.arange(len(page))
    on = np.flatnonzero(flat_ | tall)
    x1, y1, x2, y2, page, seq, f = x1[on], y1[on], x2[on], y2[on], page[on], seq[on], flat_[on]
    lo, hi = np.where(f, np.minimum(x1, x2), np.minimum(y1, y2)), np.where(f, np.maximum(x1, x2), np.maximum(y1, y2))
    across, middle = np.where(f, y1, x1), np.where(f, (y1 + y2) / 2, (x1 + x2) / 2)
    wide, band = np.floor(width[on] * 2 + 0.5), np.floor(middle / eps + 0.5) * eps
    level = np.floor(color[:, on] * 255 + 0.5).astype(np.int64)
    for k, row in enumerate(level):  # two hex digits a channel, as hex_color cuts them
        known, back = np.unique(row, return_inverse=True)
        level[k] = np.array([int(f"{v % 2**64:02x}"[:2], 16) for v in known.tolist()], np.int64)[back]
    key = np.stack([page, *level, wide, f, band])
    order = np.lexsort((seq, lo, *key[::-1]))
    key, lo, hi, across, f, wide, page = key[:, order], lo[order], hi[order], across[order], f[order], wide[order], page[order]
    n = len(lo)
    fresh = np.ones(n, bool)
    fresh[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
    group = np.cumsum(fresh) - 1
    mean = np.bincount(group, weights=hi - lo) / np.bincount(group) if n else np.zeros(0)
    values, rank = np.unique(hi, return_inverse=True)
    reach = np.maximum.accumulate(group * (len(values) + 1) + rank) - group * (len(values) + 1)  # the farthest end of a group so far, as a place in values
    opens = fresh.copy()
    opens[1:] |= lo[1:] - values[reach[:-1]] >= np.maximum(8.0, 0.4 * mean)[group[1:]]
    begins = np.flatnonzero(opens)
    run = np.cumsum(opens) - 1
    run_no = run - run[np.flatnonzero(fresh)][group] if n else run
    lo, f, across = lo[begins], f[begins], across[begins]
    hi = np.maximum.reduceat(hi, begins) if n else hi
    return page[begins], run_no[begins], np.where(f, [lo, across, hi, across], [across, lo, across, hi]), wide[begins] / 2


ORIGINS = ("rect", "dash", "diagonal", "path")


def reconciled(d: Drawing, vp: np.ndarray, eps: float) -> tuple:
    """page, origin (a place in ORIGINS), id, ends, stroke_width of the segments that ``paths.reconciled`` has."""
    p = d.paths
    page, n = p[0].astype(np.int64), p[18].astype(np.int64)
    a, b = vp[:, page], p[12:18]
    m = (a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5])
    of = np.repeat(np.arange(len(n)), n)
    m0, m1, m2, m3, m4, m5 = (row[of] for row in m)
    s = d.segs
    x1, y1, x2, y2 = m0 * s[0] + m2 * s[1] + m4, m1 * s[0] + m3 * s[1] + m5, m0 * s[2] + m2 * s[3] + m4, m1 * s[2] + m3 * s[3] + m5
    dx, dy = np.abs(x2 - x1), np.abs(y2 - y1)
    swap = np.where(dy <= dx, x1 > x2, y1 > y2)
    view = np.stack([np.where(swap, x2, x1), np.where(swap, y2, y1), np.where(swap, x1, x2), np.where(swap, y1, y2)])
    level = np.bincount(of[(dx > 0.5) & (dy > 0.5)], minlength=len(n)) == 0
    curved = p[19] > 0
    rect, rounded = level & ~curved & (n == 4), (level & ~curved & (n > 4)) | (level & curved & (p[2] > 0))
    single = ~rect & ~rounded & (n == 1)
    many = ~rect & ~single
    begins = np.cumsum(n) - n
    corner = lambda f, k: f.reduce(view[[k, k + 2]][:, begins[rect] + np.arange(4)[:, None]], axis=(0, 1))
    x, y = corner(np.minimum, 0), corner(np.minimum, 1)
    w, h = corner(np.maximum, 0) - x, corner(np.maximum, 1) - y
    r, b = x + w, y + h
    whole, low = (h >= eps) & (w >= eps), h < eps
    my, mx = (y + b) / 2, (x + r) / 2
    thin = np.where(low, [x, my, r, my], [mx, y, mx, b])[:, ~whole]
    x, y, r, b = x[whole], y[whole], r[whole], b[whole]
    edges = np.stack([np.stack(e) for e in ((x, y, r, y), (r, y, r, b), (x, b, r, b), (x, y, x, b))], axis=2).reshape(4, -1)
    who = np.flatnonzero(rect)
    strokes = view[:, begins[single]]
    slanted = (np.abs(strokes[2] - strokes[0]) > eps) & (np.abs(strokes[3] - strokes[1]) > eps)
    dash_page, run, ends, wide = _dashes(page[single], strokes, p[4][single], p[5:8][:, single], eps)
    pieces = [(0, who[~whole], thin), (0, np.repeat(who[whole], 4), edges), (2, np.flatnonzero(single)[slanted], strokes[:, slanted]), (3, of[many[of]], view[:, many[of]])]
    cat = lambda own, f: np.concatenate([own, *[f(i) for _, i, _ in pieces]])
    origin = np.concatenate([np.full(len(run), 1), *[np.full(len(i), k) for k, i, _ in pieces]])
    return cat(dash_page, lambda i: page[i]), origin, cat(run, lambda i: p[1][i].astype(np.int64)), np.concatenate([ends, *[v for *_, v in pieces]], axis=1), cat(wide, lambda i: p[4][i])
