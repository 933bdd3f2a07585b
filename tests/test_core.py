"""Operators against brute force, small pages with known results, and queries against SQL."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from leafwork.functions import exprs, folds
from leafwork.operators import clusters, columns, detections, diff, lattice, markup, paths, regions, versions
from leafwork.plans import registry
from leafwork.sources import readers


def groups(values, tol, mode):
    """First-match grouping over all groups, as a plain loop."""
    made, out = [], []
    for v in sorted(values):
        for k, g in enumerate(made):
            ref = g[0] if mode != "members" else sum(g[2]) / len(g[2])
            if abs(ref - v) <= tol:
                if mode == "running":
                    g[0] = (g[0] * g[1] + v) / (g[1] + 1)
                g[1] += 1
                g[2].append(v)
                out.append(k)
                break
        else:
            made.append([v, 1, [v]])
            out.append(len(made) - 1)
    return out


@pytest.mark.parametrize("mode", ["running", "members", "anchor"])
def test_last_group_fold_equals_first_match(spark, mode):
    rng = random.Random(1)
    pages = {p: [float(rng.randint(0, 60)) for _ in range(rng.randint(1, 25))] for p in range(60)}
    rows = [(p, i, v) for p, vs in pages.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "page long, idx long, v double").repartition(3)
    got = folds.sorted_groups(df, ["page"], F.col("v"), ["idx"], F.lit(3.0), mode, "g").orderBy("page", "v", "idx").collect()
    for p, vs in pages.items():
        assert [r["g"] for r in got if r["page"] == p] == groups(vs, 3.0, mode)


def test_merged_intervals(spark):
    rng = random.Random(2)
    rows = [(p, float(a), float(a + rng.randint(0, 9))) for p in range(30) for a in (rng.randint(0, 80) for _ in range(12))]
    got = {}
    for r in folds.merged_intervals(spark.createDataFrame(rows, "p long, lo double, hi double"), ["p"], "lo", "hi", 2.0).collect():
        got.setdefault(r["p"], []).append((r["lo"], r["hi"]))
    for p in range(30):
        want = []
        for _, lo, hi in sorted(r for r in rows if r[0] == p):
            if want and lo <= want[-1][1] + 2:
                want[-1] = (want[-1][0], max(want[-1][1], hi))
            else:
                want.append((lo, hi))
        assert sorted(got[p]) == want


GRID_H = [(y, 0.0, 300.0) for y in (0.0, 50.0, 100.0, 150.0)]
GRID_V = [(x, 0.0, 150.0) for x in (0.0, 100.0, 200.0, 300.0)]
EDGES = ([0.0, 50.0, 100.0, 150.0], [0.0, 100.0, 200.0, 300.0])


def test_spans_of_small_grids():
    assert lattice.cell_spans(*EDGES, GRID_H, GRID_V, 5) == [(r, c, 1, 1) for r in range(3) for c in range(3)]
    cut = [v for v in GRID_V if v[0] != 100.0] + [(100.0, 50.0, 150.0)]
    assert (0, 0, 1, 2) in lattice.cell_spans(*EDGES, GRID_H, cut, 5) and len(lattice.cell_spans(*EDGES, GRID_H, cut, 5)) == 8
    cut = [h for h in GRID_H if h[0] != 50.0] + [(50.0, 100.0, 300.0)]
    assert (0, 0, 2, 1) in lattice.cell_spans(*EDGES, cut, GRID_V, 5)


def test_slots_and_lattice(spark):
    segs = [(1, i, 0.0, y, 300.0, y) for i, y in enumerate((10.0, 60.0, 110.0, 160.0))] + [(1, 10 + i, x, 10.0, x, 160.0) for i, x in enumerate((0.0, 100.0, 200.0, 300.0))]
    grid = lattice.lattices(spark.createDataFrame(segs, "page long, seq long, x1 double, y1 double, x2 double, y2 double"), ["page"])
    assert [tuple(r) for r in grid.select("rows", "cols").collect()] == [([10.0, 60.0, 110.0, 160.0], [0.0, 100.0, 200.0, 300.0])]
    cells = spark.createDataFrame([(1, 0, 0, 2, 1), (1, 0, 1, 1, 2), (1, 1, 0, 1, 1)], "page long, row long, ord long, rowspan long, colspan long")
    got = {(r["r"], r["c"]): (r["row"], r["ord"]) for r in lattice.grid_slots(cells, ["page"]).collect()}
    assert got == {(0, 0): (0, 0), (1, 0): (0, 0), (0, 1): (0, 1), (0, 2): (0, 1), (1, 1): (1, 0)}


def test_line_classes_and_roles(spark):
    texts = ["• a", "1. b", "iv) c", "-x", "prose", "", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [r[0] for r in df.orderBy("i").select(regions.line_class(F.col("t"), F.when(F.col("i") == 6, 24.0).otherwise(12.0), F.lit(1), F.lit(12.0))).collect()]
    assert got == ["LIST", "LIST", "LIST", "PARAGRAPH", "PARAGRAPH", None, "PARAGRAPH"]
    roles = [r[0] for r in spark.createDataFrame([("A WARNING HERE",), ("SEE NOTE",), ("NOTEBOOK",)], "t string").select(exprs.box_role(F.col("t"))).collect()]
    assert roles == ["warning", "note", "generic"]


def test_dashes_become_one_line(spark):
    from leafwork.operators import segments

    rows = [(1, i, 16.0 * i, 50.0, 16.0 * i + 10, 50.0) for i in range(12)]
    got = segments.dash_runs(spark.createDataFrame(rows, "page long, seq long, x1 double, y1 double, x2 double, y2 double"), ["page"]).collect()
    assert [(r["lo"], r["hi"], r["pieces"]) for r in got] == [(0.0, 186.0, 12)]


def test_band_sections(spark):
    ys = [0.0, 43.0, 86.0, 129.0, 311.0, 354.0, 397.0]
    got = clusters.band_sections(spark.createDataFrame([(1, i, y) for i, y in enumerate(ys)], "page long, band long, y double"), ["page"]).orderBy("y").collect()
    assert [r["section"] for r in got] == [0, 0, 0, 0, 1, 1, 1] and got[0]["limit"] == 107.5


def test_two_columns(spark):
    rows = [(1, i, f"w{i}", 50.0 if i % 2 else 350.0, 20.0 * i, 200.0, 12.0, 18.0, 612.0) for i in range(12)]
    df = spark.createDataFrame(rows, "page long, idx long, str string, vx double, vy double, v_width double, s double, col_gap_min double, width double")
    splits = columns.page_columns(clusters.y_bands(df, ["page"], F.lit(5.4)), ["page"])
    assert splits.first()["splits"] == [300.0]
    assert {r["column"] for r in columns.column_buckets(df, splits, ["page"]).collect()} == {0, 1}


def test_drawing_state():
    s = paths.PageState((1, 0, 0, -1, 0, 100))
    for fn, a in (("save", []), ("transform", [2, 0, 0, 2, 10, 0]), ("setFillRGBColor", [1, 0, 0]), ("rectangle", [0, 0, 5, 10]), ("rectangle", [5, 0, 5, 10]), ("fill", []), ("restore", []), ("moveTo", [0, 0]), ("lineTo", [10, 0]), ("lineTo", [10, 10]), ("closePath", [])):
        s.apply(fn, a, None, None, None)
    s.finish()
    assert s.fills == [(20.0, 80.0, 10.0, 20.0, (1, 0, 0))] and s.paths[-1]["closed"] and len(s.paths[-1]["segs"]) == 3
    free = paths.PageState((1, 0, 0, -1, 0, 100), compat=False)
    for x in (0, 5):
        free.apply("rectangle", [x, 0, 5, 10], None, None, None)
    free.apply("fill", [], None, None, None)
    assert len(free.fills) == 2


def test_markup_tree(spark):
    raw = '<page number="1"><table><otsl><fcel>a<fcel>b<nl/><fcel>c<ecel><nl/></otsl></table></page><page number="2"><section_header>T & x</section_header><list_item>i</list_item><list_item>j</list_item></page>'
    got = markup.rendered(spark.createDataFrame([(1, raw), (2, None)], "id long, raw string"), ["id"]).collect()
    assert len(got) == 1
    assert "## T & x" in got[0]["markdown"] and "<h2>T &amp; x</h2>" in got[0]["html"] and "<ul>\n<li>i</li>\n<li>j</li>\n</ul>" in got[0]["html"]


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_diff_parts():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert diff.common_length(a, b) == brute_lcs(a, b)
        got = diff.parts(a, b)
        assert [x for k, v in got if k != "added" for x in v] == a and [x for k, v in got if k != "removed" for x in v] == b
        assert sum(len(v) for k, v in got if k == "same") == brute_lcs(a, b)


def test_suppression_and_history(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 0.0, 3.0, 10.0, 10.0, 0.8), (1, 3, 50.0, 0.0, 10.0, 10.0, 0.3)], "page long, id long, x double, y double, w double, h double, conf double")
    assert sorted(r["id"] for r in detections.suppressed(boxes, ["page"]).collect()) == [1, 3]
    steps = spark.createDataFrame([(1, t, c) for t, c in enumerate(["a", "a", "b", None, None, "c"])], "d long, t long, c string")
    assert [r["c"] for r in versions.history(steps, ["d"], ["t"], "c", 3).orderBy("version").collect()] == ["b", None, "c"]


def test_readers_and_stream(spark, tmp_path):
    from leafwork.streaming.pages import PageTable, bursts

    (tmp_path / "a.md").write_text("# T\nsome **b**\n")
    assert readers.markdown_files(spark, str(tmp_path / "a.md")).first()["html"].startswith("<h1>T</h1>\n<p>some <strong>b</strong></p>")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7\n...")
    assert readers.file_headers(spark, str(tmp_path / "a.pdf")).first()["version"] == "1.7"
    table = PageTable(spark, str(tmp_path / "pages"), ["p"], ["ts"])
    batch = lambda *rows: spark.createDataFrame(rows, "p long, ts long, html string")
    table.upsert(batch((1, 1, "a"), (2, 1, "b"), (1, 2, "c")), 0)
    table.upsert(batch((2, 5, "d"), (1, 1, "late")), 1)
    table.upsert(batch((2, 9, "again")), 1)
    assert sorted((r["p"], r["html"]) for r in table.read().collect()) == [(1, "c"), (2, "d")]
    (tmp_path / "pages" / "v2").mkdir()  # a batch that died while it wrote
    assert sorted((r["p"], r["html"]) for r in table.read().collect()) == [(1, "c"), (2, "d")]
    table.upsert(batch((2, 9, "e")), 2)
    assert sorted((r["p"], r["html"]) for r in table.read().collect()) == [(1, "c"), (2, "e")]
    assert sorted(p.name for p in (tmp_path / "pages").glob("v*")) == ["v1", "v2"]
    ev = spark.sql("select 'k' k, timestamp_millis(t) ts, c from values (0, 'a'), (100, 'b'), (900, 'c') v(t, c)")
    assert sorted((r["c"], r["edits"]) for r in bursts(ev, "k", "ts", "c").collect()) == [("b", 2), ("c", 1)]


def test_registry():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["segment_orientation_counts", "y_bands", "gutters", "dash_runs", "underlines", "blocks", "zones", "gfm_tables", "doctags_tokens", "line_diff", "page_upsert_latest", "column_rules", "layout_classes", "struct_replaced", "full_width_items", "table_edges", "dragged_columns", "nudged_regions", "reordered_regions"])
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(f"select {', '.join(names)} from ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, want))


def test_grids_of_long_orders_are_whole(spark, tmp_path):
    from leafwork.plans import extraction
    from leafwork.plans.grid import ruled

    rows = [(page, i, i, i, 1.0, "N", 10.0, datetime.date(2020, 1, 1)) for page, n in ((7, 30), (8, 3)) for i in range(n)]
    kind = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_extendedprice double, l_shipdate date"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    segs = ruled(spark, str(tmp_path)).collect()
    for page, n in ((7, 30), (8, 3)):
        tops = {r["y1"] for r in segs if r["page"] == page and r["kind"] == "H"}
        assert tops == {32.0 + 24 * k + page % 3 for k in range(n + 1)}
        assert {r["y1"] for r in segs if r["page"] == page and r["kind"] == "V"} == {32.0 + 24 * k for k in range(n)}
    given = extraction._inputs(spark, str(tmp_path))[1]
    assert given.count() == len(segs) and {r["page"] for r in given.select("page").distinct().collect()} == {7, 8}


def test_layout_of_zones_against_a_plain_loop(spark):
    from leafwork.operators import assembly

    rng = random.Random(4)
    zones = {z: [(rng.choice(("HEADING", "HEADING", "PARAGRAPH", "IMAGE")), rng.uniform(0, 90), rng.choice((10.0, 300.0))) for _ in range(rng.randint(1, 7))] for z in range(80)}
    rows = [(z, i, t, y, x, -1) for z, found in zones.items() for i, (t, y, x) in enumerate(found)]
    df = spark.createDataFrame(rows, "zone long, seq long, type string, y_center double, x double, column long")
    from pyspark.sql import functions as F

    got = {r["zone"]: r["layout"] for r in assembly.layout_class(df, ["zone"], "seq", F.col("zone") % 2 + 1, F.lit(500.0)).collect()}
    for z, found in zones.items():
        groups = []
        for t, y, _ in found:
            if t == "HEADING":
                near = next((g for g in groups if abs(g[0] - y) < 15), None)
                if near:
                    near[:] = [(near[0] * near[1] + y) / (near[1] + 1), near[1] + 1]
                else:
                    groups.append([y, 1])
        left, right = ([t for t, _, x in found if (x < 250) == side] for side in (True, False))
        feature = z % 2 + 1 == 2 and left and all(t in ("HEADING", "IMAGE") for t in left) and "PARAGRAPH" in right
        assert got[z] == ("layout-card-grid" if any(n >= 3 for _, n in groups) else "layout-feature" if feature else "layout-equal"), z
    assert len(set(got.values())) == 3


def test_a_grid_of_one_column_is_a_box_and_the_page_frame_is_none(spark):
    from leafwork.plans import extraction

    words = [(1, i, t, x, y, 6.0 * len(t), 12.0) for i, (t, x, y) in enumerate([("NOTE: read all of these lines first", 110.0, 115.0), ("and then go on with the rest", 110.0, 145.0), ("Plain text stands below the box here", 60.0, 400.0)])]
    flat = [(100.0, y, 340.0, y) for y in (100.0, 130.0, 160.0)] + [(5.0, 20.0, 595.0, 20.0), (5.0, 780.0, 595.0, 780.0)]
    upright = [(x, 100.0, x, 160.0) for x in (100.0, 340.0)] + [(5.0, 20.0, 5.0, 780.0), (595.0, 20.0, 595.0, 780.0)]
    items = spark.createDataFrame(words, "page long, idx long, str string, vx double, vy double, v_width double, v_font double")
    segs = lambda lines: spark.createDataFrame([(1, i, *s) for i, s in enumerate(lines)], "page long, seq long, x1 double, y1 double, x2 double, y2 double")
    pages = spark.createDataFrame([(1, 600.0, 800.0)], "page long, width double, height double")
    inner = extraction.classify(items, segs(flat[:3] + upright[:2]), None, pages, ["page"]).where("type = 'BOX'").collect()
    assert [(r["id"], r["role"], r["x"], r["w"]) for r in inner] == [("n0", "note", 100.0, 240.0)] and "go on" in inner[0]["text"]
    frame = extraction.classify(items, segs(flat[3:] + upright[2:]), None, pages, ["page"], skip=("LATTICE_TABLE",))
    assert frame.where("type = 'BOX'").count() == 0


def test_cells_of_deep_trees_are_found(spark):
    from leafwork.operators import markup

    chain = [(1, None, "Table"), (2, 1, "TR"), *[(n, n - 1, "Div") for n in range(3, 40)], (40, 39, "TD"), (41, 40, "P")]
    nodes = spark.createDataFrame([(1, n, up, 0, role, 5 if n == 41 else None) for n, up, role in chain], "page long, node_id long, parent_id long, ord long, role string, mcid long")
    assert [tuple(r) for r in markup.struct_cells(nodes, ["page"]).collect()] == [(1, 1, 0, 0, [5])]
    cycle = spark.createDataFrame([(1, 1, 2, 0, "TD", None), (1, 2, 1, 0, "Div", None)], nodes.schema)
    with pytest.raises(ValueError, match="cycle"):
        markup.struct_cells(cycle, ["page"], depth=2)


def test_each_table_of_a_page_is_a_grid(spark):
    from leafwork.operators import lattice

    def grid(x, y, n):
        h = [(x, y + 20.0 * i, x + 100.0, y + 20.0 * i) for i in range(n)]
        return h + [(x + 25.0 * i, y, x + 25.0 * i, y + 20.0 * (n - 1)) for i in range(5)]

    pages = {1: grid(50.0, 50.0, 8) + grid(50.0, 400.0, 6) + grid(300.0, 400.0, 7), 2: grid(50.0, 50.0, 3), 3: [(0.0, 0.0, 50.0, 0.0)]}
    segs = [(p, i, *s) for p, found in pages.items() for i, s in enumerate(found)]
    segs = spark.createDataFrame(segs, "page long, seq long, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r["page"], r["rows"][0], r["cols"][0], len(r["rows"]), len(r["cols"])) for r in lattice.table_lattices(segs, ["page"]).collect())
    assert got == [(1, 50.0, 50.0, 8, 5), (1, 400.0, 50.0, 6, 5), (1, 400.0, 300.0, 7, 5), (2, 50.0, 50.0, 3, 5)]


def test_box_roles_are_those_of_the_first_60_characters_by_simple_upper_case(spark, tmp_path):
    import duckdb

    from leafwork.plans import layout

    texts = ["ß" * 8 + "a" * 48 + " tip of it", "ŉote a", "noteä b", "äinfo", "Heitschzu schbege. enbeß üchver rtd.62@mail0.example.com hint on", "see hinẗ", "ﬁne note"]
    spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in layout.QUERIES["box_roles"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(db.execute(layout.ORACLES["box_roles"]).fetchall())
    assert [r[2] for r in got] == ["tip", "generic", "note", "note", "tip", "generic", "note"]


def test_lattices_are_one_pass_and_equal_the_joined_form(spark, monkeypatch):
    import random

    rng, segs = random.Random(7), []
    for page in range(12):
        for i in range(rng.randint(4, 40)):
            at, lo = 12.0 * rng.randint(0, 9) + rng.choice([0, 0.25, 3.5]), 30.0 * rng.randint(0, 4)
            a, b = rng.sample([lo, lo + rng.choice([3.0, 60.0, 150.0])], 2)
            segs.append((page, i, *((a, at, b, at + rng.choice([0, 2.0])) if i % 2 else (at * 1.5, a, at * 1.5, b))))
    segs = spark.createDataFrame([*segs, (None, 0, 0.0, 0.0, 90.0, 0.0), (3, 99, None, 0.0, 90.0, 0.0)], "page long, seq long, x1 double, y1 double, x2 double, y2 double")
    h, v = (lattice.segments.collinear(segs, ["page"], k) for k in "HV")
    points, want = lattice.crossings(h, v, ["page"]), {}
    for r in lattice.grid_lines(points, ["page"]).collect():
        rows, cols, total = want.setdefault(r["page"], ([], [], {"row": 0, "col": 0}))
        total[r["axis"]] += 1
        if r["kept"]:
            (rows if r["axis"] == "row" else cols).append(r["pos"])
    n = {r["page"]: r["count"] for r in points.groupBy("page").count().collect()}
    packed = [{r["page"]: sorted(tuple(x) for x in r["a"]) for r in df.groupBy("page").agg(F.collect_list(F.struct("pos", "lo", "hi")).alias("a")).collect()} for df in (h, v)]
    ok = lambda p, rows, cols, t: n[p] >= 4 and min(t.values()) >= 2 and (t["row"] - 1) * (t["col"] - 1) >= 2 and min(len(rows), len(cols)) >= 2 and n[p] / (len(rows) * len(cols)) >= 0.25
    want = {p: (sorted(rows), sorted(cols), n[p], packed[0][p], packed[1][p]) for p, (rows, cols, t) in want.items() if ok(p, rows, cols, t)}
    monkeypatch.setattr(lattice, "cut", None)  # nothing is written on the way
    got = {r["page"]: (r["rows"], r["cols"], r["n_points"], *[[tuple(x) for x in r[c]] for c in ("h_lines", "v_lines")]) for r in lattice.lattices(segs, ["page"]).collect()}
    assert got.keys() == want.keys() and len(got) > 3
    for p, (rows, cols, points, *lines) in got.items():
        assert rows == pytest.approx(want[p][0]) and cols == pytest.approx(want[p][1]) and points == want[p][2]
        assert lines == [[pytest.approx(x) for x in side] for side in want[p][3:]]


def test_columns_of_operators_as_lists_and_matrix_products():
    import random

    import numpy as np
    import pyarrow as pa

    from leafwork.operators import paths

    columns = [["save", None, "fill", "save"], [None, None], [1.5, None, 2.0], [0.5, 1.0]]
    assert [paths._values(pa.array(c, pa.float64() if c and isinstance(c[-1], float) else pa.string())) for c in columns] == columns
    nested = pa.array([[9.0], [1.0, 2.0], None, [], [3.0]], pa.list_(pa.float64()))
    assert paths._lists(nested.slice(1)) == [[1.0, 2.0], None, [], [3.0]] and paths._lists(nested.slice(2, 1)) == [None]
    rng = random.Random(3)
    full = lambda m: np.array([[m[0], m[2], m[4]], [m[1], m[3], m[5]], [0, 0, 1]])
    for _ in range(20):
        a, b = ([rng.uniform(-2, 2) for _ in range(6)] for _ in "ab")
        assert np.allclose(full(paths._product(a, b)), full(a) @ full(b))


def _random_ops(rng, n):
    """Operators of a page as rows (fn, args, sub_ops, sub_args, image_id)."""
    num = lambda k: [float(rng.choice([0, 0, 1, 2, 5, 10, 12.5, 40, -3])) for _ in range(k)]
    out = []
    for _ in range(n):
        fn = rng.choice(["save", "restore", "restore", "transform", "rectangle", "rectangle", "moveTo", "moveTo", "lineTo", "lineTo", "lineTo", "closePath", "curveTo", "curveTo2", "curveTo3", "fill", "eoFill", "stroke", "setLineWidth", "setFillGray", "setFillRGBColor", "setFillCMYKColor", "setFillColorN", "setStrokeRGBColor", "constructPath", "paintImageXObject", "paintImageMaskXObject", "paintInlineImage", "clip"])
        sub = [rng.choice(["moveTo", "lineTo", "rectangle", "closePath", "curveTo3"]) for _ in range(rng.randrange(4))]
        k = {"transform": 6, "setLineWidth": 1, "setFillGray": 1, "setFillRGBColor": 3, "setStrokeRGBColor": 3, "setFillCMYKColor": 4, "setFillColorN": rng.randrange(5)}.get(fn, paths.SIZES.get(fn, 0))
        args = [rng.choice([0.0, 0.5, 1.0]) for _ in range(k)] if fn.startswith("set") else num(k) if fn != "transform" else [rng.choice([1.0, 0.5]), rng.choice([0.0, 0.0, 0.25]), 0.0, rng.choice([1.0, -1.0]), *num(2)]
        built = fn == "constructPath"
        out.append((fn, args or None, sub if built else None, num(sum(paths.SIZES[x] for x in sub)) if built else None, rng.choice(["a", None]) if fn.startswith("paint") else None))
    return out


def test_pages_side_by_side_draw_what_each_draws_alone(spark):
    rng = random.Random(8)
    pages = [_random_ops(rng, rng.choice([1, 20, 60])) for _ in range(300)] + [_random_ops(rng, 400)]
    view = [(1.0, 0.0, 0.0, -1.0, 0.0, float(100 + p % 3)) for p in range(len(pages))]
    want = {"fills": [], "paths": [], "images": []}
    for p, ops in enumerate(pages):
        state = paths.PageState(view[p])
        for fn, a, subs, sub_args, image in ops:
            state.apply(fn, a or [], subs, sub_args, image)
        state.finish()
        want["fills"] += [(p, i, *f[:4], list(f[4])) for i, f in enumerate(state.fills)]
        want["images"] += [(p, i, *m) for i, m in enumerate(state.images)]
        want["paths"] += [(p, x["id"], [list(s) for s in x["segs"]], [list(c) for c in x["curves"]], x["closed"], x["filled"], x["stroke_width"], list(x["stroke_color"]), list(x["fill_color"]), x["construct_path_id"], list(x["ctm"])) for x in state.paths]
    rows = [(p, i, *op) for p, ops in enumerate(pages) for i, op in enumerate(ops)]
    rng.shuffle(rows)
    ops = spark.createDataFrame(rows, "page long, op_seq long, fn string, args array<double>, sub_ops array<string>, sub_args array<double>, image_id string").repartition(3)
    vp = spark.createDataFrame(list(enumerate(map(list, view))), "page long, vp array<double>")
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])
    assert plain(paths.filled_rects(ops, vp, ["page"])) == want["fills"] and len(want["fills"]) > 100
    assert plain(paths.image_meta(ops, vp, ["page"])) == want["images"] and len(want["images"]) > 100
    found = paths.subpaths(ops, vp, ["page"])
    assert plain(found) == want["paths"]
    both = [sorted(tuple(r) for r in df.select("page", "origin", "id", "x1", "y1", "x2", "y2", "stroke_width").collect()) for df in (paths.drawn_segments(ops, vp, ["page"]), paths.reconciled(found, vp, ["page"]))]
    assert both[0] == both[1] and {r[1] for r in both[0]} == {"rect", "dash", "diagonal", "path"}


def test_operators_are_cut_into_chunks_between_pages(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(paths, "OPS_AT_ONCE", 4)
    rows = [(1, 0), (1, 1), (2, 1), (2, 0), (2, 2), (2, 3), (2, 4), (2, 5), (None, 0), (3, 0)]
    batches = [pa.RecordBatch.from_pydict({"page": pa.array([p for p, _ in part], pa.int64()), "op_seq": [i for _, i in part], "fn": ["save restore"] * len(part), "args": pa.array([[]] * len(part), pa.list_(pa.float64()))}) for part in (rows[:1], [], rows[1:3], rows[3:7], rows[7:])]
    got = [(c["page"].to_pylist(), c["op_seq"].to_pylist(), starts.tolist()) for c, starts in paths._chunks(iter(batches), 1)]
    assert [x for pages, seq, _ in got for x in zip(pages, seq, strict=True)] == [*rows[:2], (2, 0), (2, 1), *rows[4:]]
    assert len(got) > 1 and all(len(set(pages)) == len(starts) for pages, _, starts in got)


def test_runs_of_operators_are_their_operators():
    import numpy as np
    import pyarrow as pa

    from leafwork.operators import drawing

    single = [("save", []), ("transform", [1.0, 0.0, 0.0, 1.0, 5.0, 6.0]), ("setFillColorN", [0.5]), ("rectangle", [1.0, 2.0, 3.0, 4.0]), ("fill", []), ("restore", []), ("clip", [])]
    run = [("save transform", single[1][1]), single[2], ("rectangle fill restore", single[3][1]), single[6]]
    flat = [drawing.flat({"fn": pa.array([f for f, _ in rows]), "args": pa.array([a for _, a in rows], pa.list_(pa.float64()))}, np.array([0, k]), np.eye(6, 2)) for rows, k in ((single, 2), (run, 1))]
    assert [[(o.names[c], o.args(i)) for i, c in enumerate(o.code)] for o in flat] == [single] * 2 and all(o.first.tolist() == [0, 2] and o.size.tolist() == [2, 5] for o in flat)
    for fn in ("save clip", "save transform"):
        with pytest.raises(ValueError):
            drawing.flat({"fn": pa.array([fn]), "args": pa.array([[1.0]])}, np.array([0]), np.eye(6, 1))


@pytest.mark.parametrize("name", ["ctm_stack", "reconciled_segments"])
def test_drawing_queries_make_the_ruled_segments_once(spark, name, capsys):
    from leafwork.plans import registry

    registry.QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 3 and "collect_list" not in plan and "HashJoin" not in plan and "SortMergeJoin" not in plan


def test_detectors_of_one_pass_agree_with_the_operators(spark):
    from pyspark.sql import functions as F

    from leafwork.operators import lattice, pageregions, regions, scale, streamtables

    rng, items, segs = random.Random(5), [], []
    for page in range(60):
        rows, cols, x0, y0, wide = rng.randint(1, 6), rng.randint(1, 4), rng.choice([40.0, 120.0]), rng.choice([40.0, 90.0]), rng.choice([60.0, 110.0])
        lines = [(x0, y0 + 26.0 * r, x0 + cols * wide, y0 + 26.0 * r) for r in range(rows + 1) if rng.random() < 0.95]
        lines += [(x0 + wide * c, y0 + 26.0 * r, x0 + wide * c, y0 + 26.0 * (r + 1)) for c in range(cols + 1) for r in range(rows) if rng.random() < 0.9]
        lines += [(50.0, 500.0, 350.0, 500.0), (50.0, 540.0, 350.0, 540.0), (50.0, 500.0, 50.0, 540.0), (350.0, 500.0, 350.0, 540.0)] * (page % 2)
        segs += [(page, i, *s) for i, s in enumerate(lines)]
        words = [("12", 60.0 + 90 * c + rng.choice((0, 3)), 300.0 + 17 * r) for r in range(rng.randint(2, 6)) for c in range(rng.randint(3, 4))] + [("a text within a frame", 60.0, 520.0)]
        items += [(page, i, t, x, y, 6.0 * len(t), 12.0) for i, (t, x, y) in enumerate(words)]
    it = spark.createDataFrame(items, "page long, idx long, str string, vx double, vy double, v_width double, v_font double")
    sg = spark.createDataFrame(segs, "page long, seq long, x1 double, y1 double, x2 double, y2 double")
    scaled = it.join(scale.page_scale(it, ["page"]), "page")
    grids = {(r["page"], f"l_{r['y_part']}_{r['x_part']}", len(r["cols"]), r["cols"][0], r["rows"][-1]) for r in lattice.table_lattices(sg, ["page"], y_gap=24.0, x_gap=18.0).collect()}
    tables = {(r["page"], f"s{r['section']}", round(r["confidence"], 9)) for r in streamtables.candidates(scaled, ["page"]).where("accepted").collect()}
    boxes = {(r["page"], r["seq"], r["y"], r["h"], tuple(r["idxs"])) for r in regions.boxes(sg, scaled, ["page"], F.lit(660.0), F.col("table_pad"), 10.8).collect()}
    assert len(grids) > 20 and len(tables) > 20 and len(boxes) > 20
    found = {"grids": set(), "tables": set(), "boxes": set()}
    for page in range(60):
        mine = sorted((*i[1:], i[2]) for i in items if i[0] == page)
        lines = [s[1:] for s in segs if s[0] == page]
        found["grids"] |= {(page, g[0], g[1], g[2], g[3] + g[5]) for g in pageregions._grids(lines, 12.0)}
        found["tables"] |= {(page, t[0], round(t[5], 9)) for t in pageregions._tables(mine, 12.0, 12.0 * 0.45, 12.0 * 0.8, 0.6)}
        found["boxes"] |= {(page, q, y, h, tuple(i[0] for i in held)) for q, x, y, w, h, held in pageregions._frames(lines, mine, 660.0, 9.6)}
    assert {(*g[:4], round(g[4], 6)) for g in found["grids"]} == {(*g[:4], round(g[4], 6)) for g in grids}
    assert found["tables"] == tables and found["boxes"] == boxes


def _orders(spark, folder, sizes):
    rows = [(page, i, 7 * page + i, i, 1.0, "N", 10.0, datetime.date(2020, 1, 1)) for page, n in sizes.items() for i in range(n)]
    kind = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_extendedprice double, l_shipdate date"
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/lineitem.parquet")


def test_regions_of_whole_pages_are_one_plan_that_writes_nothing(spark, tmp_path):
    from pathlib import Path

    from leafwork.functions.lineage import shared_folder
    from leafwork.plans import extraction

    _orders(spark, tmp_path, {7: 30, 8: 3})
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("cut-*"))
    got = extraction.extracted_regions(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert set(folder.glob("cut-*")) == before
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") <= 12
    assert {(r["page"], r["type"], r["h"]) for r in got.collect()} == {(7, "LATTICE_TABLE", 720.0), (8, "LATTICE_TABLE", 72.0)}


def test_pages_read_their_regions_once(spark, tmp_path):
    from leafwork.plans import extraction

    _orders(spark, tmp_path, {7: 30, 8: 3})
    got = extraction.extracted_pages(spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = {r["page"]: r for r in got.collect()}
    assert {p: r["tables"] for p, r in rows.items()} == {7: 1, 8: 1}
    assert rows[8]["text"] == "56 0 1 N 57 1 1 N 58 2 1 N" and rows[8]["html"] == f"<p>{rows[8]['text']}</p>"
