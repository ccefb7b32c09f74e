import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions.rects import WORLD, Rect
from tessera.functions import strings as S
from tessera.operators import planning as P
from tessera.operators import tree as TR
from tessera.operators import index as I
from tessera.operators import opclass as O
from tessera.operators.grid import collect_ids, grid_side, with_cell
from tessera.operators.index import OVERFLOW, IndexedTable, Names, build_index, make_index, register_index, remove_old, with_part
from tessera.operators.opclass import IndexParams
from tessera.operators.order import with_place
from tessera.operators.quad import Quad
from tessera.operators.scan import linear_scan
from tessera.operators.trie import Trie

EDGES = [-180.0, -90.0, -45.0, 0.0, 45.0, 90.0, 180.0]


def some_points(n=400, seed=1):
    r = random.Random(seed)
    rows = [(x, y) for x in EDGES for y in (-90.0, -45.0, 0.0, 45.0, 90.0)]
    rows += [(round(r.gauss(20, 30), 2), round(r.uniform(-90, 90), 2)) for _ in range(n)] + [(10.5, 10.5)] * 60
    return [(i, max(-180.0, min(180.0, x)), y) for i, (x, y) in enumerate(rows)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(some_points(), "id long, x double, y double").cache()


def test_opened_as_something_else(spark, points, table, tmp_path):
    """Parameters are those stored; another family or space is refused instead of answering wrongly."""
    assert IndexedTable(spark, table.names, Quad(blocksize=7, resolution=3)).range((-180, -90), (180, 90)).count() == 495
    for other in (Quad(world=Rect(0, 0, 1, 1)), Trie()):
        with pytest.raises(ValueError, match="built as"):
            IndexedTable(spark, table.names, other)
    names = Names(str(tmp_path), "OSM", "Quad", "w")
    small = Rect(-20, -30, 77, 41)
    built = build_index(points, Quad(world=small, resolution=12), names, 1.0, parts=22, outside="overflow")
    want = sorted(map(tuple, linear_scan(points, Rect(-50, -50, 50, 50)).collect()))
    assert sorted(map(tuple, built.range((-50, -50), (50, 50)).collect())) == want
    with pytest.raises(ValueError):
        IndexedTable(spark, names, Quad())
    with pytest.raises(ValueError):
        IndexedTable(spark, names)


def test_a_failed_rebuild_leaves_the_index(spark, points, tmp_path, monkeypatch):
    names = Names(str(tmp_path), "OSM", "Quad", "/a/points")
    build_index(points, Quad(resolution=8), names, 1.0, parts=4)
    outside = points.union(spark.createDataFrame([(9999, 500.0, 0.0)], points.schema))
    with pytest.raises(Exception, match="outside the index"):
        build_index(outside, Quad(resolution=8), names, 1.0, parts=4)
    with monkeypatch.context() as m:  # one that has written its data and fails in its catalog
        m.setattr(I, "part_leaves", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            build_index(points.limit(9), Quad(resolution=8), names, 1.0, parts=4)
    reader = IndexedTable(spark, names)
    assert reader.records().count() == 495 and reader.range((-180, -90), (180, 90)).count() == 495
    again = build_index(points.limit(100), Quad(resolution=9), names, 1.0, parts=7)
    assert again.records().count() == 100 and IndexedTable(spark, names).partitions.count() == 7
    assert reader.range((-180, -90), (180, 90)).count() == 495  # who opened the version before still reads it
    assert len(remove_old(spark, names)) == 2 and IndexedTable(spark, names).range((-180, -90), (180, 90)).count() == 100
    other = Names(str(tmp_path), "OSM", "Quad", "/b/points")
    assert other.local("v") != names.local("v")


@pytest.fixture(scope="module")
def table(spark, points, tmp_path_factory):
    return build_index(points, Quad(blocksize=20, resolution=8), Names(str(tmp_path_factory.mktemp("quad")), "OSM", "Quad", "a/points"), 1.0, parts=13)


def python_path(x, y, depth, world=WORLD):
    """Halving, level by level."""
    x0, y0, x1, y1, out = world.x0, world.y0, world.x1, world.y1, ""
    for _ in range(depth):
        mx, my = (x0 + x1) / 2, (y0 + y1) / 2
        right, low = x >= mx, y < my
        x0, x1 = (mx, x1) if right else (x0, mx)
        y0, y1 = (y0, my) if low else (my, y1)
        out += str(right + 2 * low)
    return out


@pytest.mark.parametrize("depth", [1, 9, 18, 19, 40])
def test_paths(points, depth):
    for r in points.withColumn("p", Quad().path(depth)).collect():
        assert r["p"] == python_path(r["x"], r["y"], depth)


def test_paths_at_the_edges_of_deep_cells(spark):
    """Points on cells' edges and next to them, to the last bit; regions of paths and their rectangles agree."""
    r, rows = random.Random(4), []
    for _ in range(300):
        i, level = r.randrange(1, 1 << 30), 30
        x, y = -180 + i * 360 / 2**level, 90 - i * 180 / 2**level
        rows += [(x, y), (math.nextafter(x, -200), math.nextafter(y, -200)), (math.nextafter(x, 200), math.nextafter(y, 200))]
    rows = [(x, max(-90.0, min(90.0, y))) for x, y in rows if -180 <= x <= 180]
    q = Quad()
    got = spark.createDataFrame(rows, "x double, y double").withColumn("p", q.path(40)).withColumn("c", q.cell_of(F.col("p"))).collect()
    for g in got:
        assert g["p"] == python_path(g["x"], g["y"], 40)
        cell = q.cell(g["p"])
        assert cell.x0 <= g["x"] <= cell.x1 and cell.y0 <= g["y"] <= cell.y1 and (cell.x0, cell.y0) == (g["c"]["x"], g["c"]["y"])


def test_integer_worlds(spark):
    q = Quad(world=Rect(0, 0, 8, 8))
    assert [r[0] for r in spark.createDataFrame([(1.0, 7.0), (8.0, 0.0)], "x double, y double").select(q.path(3)).collect()] == ["001", "333"]
    for bad in (dict(world=Rect(0, 0, 0, 1)), dict(resolution=60)):
        with pytest.raises(ValueError):
            Quad(**bad)


def test_leaves_hold_every_record_once(points):
    q = Quad(blocksize=20, resolution=8)
    paths = [python_path(x, y, 8) for _, x, y in some_points()]
    count = Counter(p[:i] for p in paths for i in range(9))
    want = Counter(next(p[:i] for i in range(1, 9) if count[p[:i]] <= 20 or i == 8) for p in paths)
    got = {r["leaf"]: r["n"] for r in TR.leaves(TR.cells(points, q, 8), q).collect()}
    assert got == want and max(got.values()) >= 60  # equal points are never parted and never dropped
    assert Counter(r["leaf"] for r in TR.with_leaf(points, q).collect()) == want


@pytest.mark.parametrize("chunk,block,depth", [(30, 5, 40), (7, 1, 12), (100_000, 20, 40)])
def test_leaves_over_chunk_borders(spark, points, monkeypatch, chunk, block, depth):
    """Leaves don't depend on how sorted records are dealt to tasks; a third of the records at one point."""
    monkeypatch.setattr(TR, "CHUNK", chunk)
    hot = points.union(spark.range(240).select("id", F.lit(33.3).alias("x"), F.lit(-7.7).alias("y")))
    paths = [python_path(r["x"], r["y"], depth) for r in hot.collect()]
    count = Counter(p[:i] for p in paths for i in range(depth + 1))
    want = Counter(next(p[:i] for i in range(1, depth + 1) if count[p[:i]] <= block or i == depth) for p in paths)
    q = Quad(blocksize=block, resolution=depth)
    got = TR.leaves(TR.cells(hot, q, depth), q).collect()
    assert {r["leaf"]: r["n"] for r in got} == want and all(r["bytes"] == 24 * r["n"] for r in got)


def test_places(spark):
    r = random.Random(1)
    rows = [(r.randrange(50), i) for i in range(500)]
    got = {i: p for _, i, p in map(tuple, with_place(spark.createDataFrame(rows, "k long, i long"), "k", "i").select("k", "i", "place").collect())}
    assert got == {i: p for p, (_, i) in enumerate(sorted(rows))}
    assert with_place(spark.createDataFrame([], "k long"), "k").count() == 0


def test_parts_by_bisection(spark, points, monkeypatch):
    q, t = Quad(), Trie()
    parts = [p for p, _ in P.plan_partitions(points, q, 100)]
    strings = spark.createDataFrame([(w,) for w in WORDS + ["Ü", "A~b", "zebra"]], "str string")
    prefixes = [p for p, _ in P.plan_partitions(strings, t, 105)]
    both = lambda: ([r["part_id"] for r in with_part(points, q, parts).orderBy("id").collect()], [r["part_id"] for r in with_part(strings, t, prefixes).orderBy("str").collect()])
    by_case = both()
    monkeypatch.setattr(O, "CASE_PARTS", 1)
    assert both() == by_case


def test_tree_shapes(points):
    deep = TR.cells(points, Quad(), 6)
    base = {r["prefix"]: r for r in TR.nodes(deep, Quad(blocksize=20, resolution=6)).collect()}
    shrunk = {r["prefix"] for r in TR.nodes(deep, Quad(blocksize=20, resolution=6, path_shrink="TREE")).collect()}
    assert set(base) - shrunk == {p for p, r in base.items() if r["children"] == 1 and p}
    full = {r["prefix"]: r["n"] for r in TR.nodes(deep, Quad(blocksize=20, resolution=6, node_shrink=False)).collect()}
    assert all(p + s in full for p, r in base.items() if r["children"] for s in "0123")
    fixed = TR.leaves(deep, Quad(resolution=6, path_shrink="NEVER")).collect()
    assert {r["level"] for r in fixed} == {6}
    with pytest.raises(ValueError):
        IndexParams(4, 0, 1)


def test_index_equals_scan(table, points):
    r = random.Random(3)
    rects = [(-170, 10, 170, 10.5), (10.5, 10.5, 10.5, 10.5), (180, 90, -180, -90), (0, -90, 0, 90), (0.001, 0.001, 0.002, 0.002)]
    rects += [tuple(r.uniform(-180, 180) if i % 2 == 0 else r.uniform(-90, 90) for i in range(4)) for _ in range(12)]
    for x1, y1, x2, y2 in rects:
        want = sorted(map(tuple, linear_scan(points, Rect.corners(x1, y1, x2, y2)).collect()))
        assert sorted(map(tuple, table.range((x1, y1), (x2, y2)).collect())) == want


def test_pruning_reaches_the_scan(table):
    seen = table.pruning((100, 50), (101, 51))
    assert seen["parts"] < seen["of_parts"] and seen["records"] < seen["of_records"] == 495
    plan = table.range((100, 50), (101, 51))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "GreaterThanOrEqual(x,100.0)" in plan and "ReadSchema: struct<id:bigint,x:double,y:double,path:string>" in plan and "Exchange" not in plan


def test_ranges_of_paths(points):
    """They hold all points of the rectangle, few others, and are few themselves."""
    r, q = random.Random(6), Quad()
    rows = points.withColumn("p", q.path(40)).collect()
    for x1, y1, x2, y2 in [(-400, -400, 400, 400), (500, 5, 600, 6), (10, 10, 11, 11)] + [tuple(r.uniform(-180, 180) / (1 + i % 2) for i in range(4)) for _ in range(20)]:
        ranges, rect = q.paths((x1, y1), (x2, y2)), Rect.corners(x1, y1, x2, y2)
        assert 0 < len(ranges) < 24
        for p in rows:
            if rect.x0 <= p["x"] <= rect.x1 and rect.y0 <= p["y"] <= rect.y1:
                assert any(a <= p["p"] <= b for a, b in ranges)
    assert sum(any(a <= p["p"] <= b for a, b in q.paths((100, 50), (101, 51))) for p in rows) < len(rows) / 20


def test_catalog(spark, table):
    again = IndexedTable(spark, table.names)
    rows = again.partitions.orderBy("part_id").collect()
    assert [r["part_id"] for r in rows] == list(range(13)) and sum(r["n"] for r in rows) == 495
    assert sum((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for r in rows) == 360 * 180
    assert again.opclass.params == IndexParams(4, 20, 8) and "Local-OSM-Quad-points-" in table.names.local("v")
    held = again.leaves.collect()
    assert sum(r["n"] for r in held) == 495 and all(r["n"] <= 20 or r["level"] == 8 for r in held)
    prefix = {r["part_id"]: r["prefix"] for r in rows}
    assert all(r["leaf"].startswith(prefix[r["part_id"]]) for r in held)
    for r in sorted(held, key=lambda r: -r["n"])[:3]:
        assert again.leaf(r["part_id"], r["leaf"]).count() == r["n"]


def test_records_outside(spark, tmp_path):
    df = spark.createDataFrame([(1, 200.0, 0.0), (2, 0.0, 0.0), (3, None, 1.0)], "id long, x double, y double")
    t = build_index(df, Quad(resolution=4), Names(str(tmp_path), "OSM", "Quad", "x"), 1.0, parts=4, outside="overflow")
    assert t.records().count() == 3 and OVERFLOW in [r["part_id"] for r in t.partitions.collect()]
    assert [r["id"] for r in t.range((-180, -90), (180, 90)).collect()] == [2]
    assert [r["id"] for r in t.range((190, -1), (210, 1)).collect()] == [1]
    with pytest.raises(Exception, match="outside the index"):
        with_part(df, Quad(), list("0123")).collect()


def test_empty_input(spark, tmp_path):
    t = build_index(spark.createDataFrame([], "id long, x double, y double"), Quad(resolution=4), Names(str(tmp_path), "OSM", "Quad", "x"), 1.0, parts=7)
    assert t.range((-180, -90), (180, 90)).count() == 0 and t.partitions.count() == 7


def test_planner(spark):
    assert [P.n_partitions(b, 1, 4) for b in (0, 1, 10)] == [4, 7, 28]
    assert P.fraction_of(None) == 1e-4 and P.fraction_of(1) == 1 and P.fraction_of(1.5) == 0.015 and P.fraction_of(0.5) == 0.5
    with pytest.raises(ValueError):
        P.fraction_of(0)
    q = Quad()
    one = spark.createDataFrame([(float(i) / 9, 50.0) for i in range(90)], "x double, y double")
    parts = P.plan_partitions(one, q, 10)
    assert len(parts) == 10 and [p for p, _ in parts][:1] == ["0"]
    assert sum(n for _, n in parts) == 90
    empty = P.plan_partitions(one.limit(0), q, 7)
    assert [p for p, _ in empty] == ["00", "01", "02", "03", "1", "2", "3"]


def plain_plan(paths, n, symbols):
    count, parts = Counter(p[:i] for p in paths for i in range(len(p) + 1)), list(symbols)
    while len(parts) < n:
        open_parts = [i for i, p in enumerate(parts) if len(p) < len(paths[0])]
        most = max(open_parts, key=lambda i: (count[parts[i]], -i))
        parts[most : most + 1] = [parts[most] + s for s in symbols]
    return [(p, count[p]) for p in parts]


@pytest.mark.parametrize("cells", [70_000, 300])
def test_planner_follows_a_crowd(spark, monkeypatch, cells):
    """All points in a box of half a degree, and strings that begin alike: the parts are even all the same, and those
    of the plain greedy division, however few counts are taken at once."""
    monkeypatch.setattr(P, "PLAN_CELLS", cells)
    r = random.Random(8)
    box = [(10.1 + r.random() / 2, 50.2 + r.random() * 0.3) for _ in range(4000)]
    parts = P.plan_partitions(spark.createDataFrame(box, "x double, y double"), Quad(), 100)
    assert len(parts) == 100 and parts == plain_plan([python_path(x, y, 40) for x, y in box], 100, "0123")
    held = [n for _, n in parts if n]
    assert sum(held) == 4000 and len(held) > 50 and max(held) < 4 * 40
    urls = ["https-www-example-org-" + "".join(r.choice("abcdef") for _ in range(6)) for _ in range(2000)]
    found = P.plan_partitions(spark.createDataFrame([(u,) for u in urls], "str string"), Trie(), 27 * 30)
    longest = max(map(len, urls))
    assert found == [(p, n) for p, n in plain_plan([u.ljust(50, "-") for u in urls], len(found), S.SYMBOLS)] and longest < 50
    assert max(n for _, n in found) < 2000 / 6


WORDS = ["a", "z", "zz", "black", "blacker", "blacker", "blot", "mor", "moss", "pat", "Zed".lower(), "x-ray", "b"] + [f"q{c}{d}" for c in "abcdefghij" for d in "klmnop"]


def test_trie(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(WORDS)), "id long, str string")
    t = build_index(df, Trie(resolution=5, blocksize=3), Names(str(tmp_path), "BasicTrie", "Trie", "w"), 1.0, parts=53)
    for lo, hi in [("a", "zzz"), ("blacker", "black"), ("mor", "pat"), ("q", "qb"), ("x", "y"), ("zz", "zz"), ("", "a")]:
        want = sorted((i, w) for i, w in enumerate(WORDS) if min(lo, hi) <= w <= max(lo, hi))
        assert sorted(map(tuple, t.range(lo, hi).collect())) == want
    assert sorted(r["str"] for r in t.prefix("bla").collect()) == ["black", "blacker", "blacker"]
    assert [r["id"] for r in t.point("mor").collect()] == [7]
    assert sum(r["n"] for r in t.leaves.collect()) == len(WORDS)
    assert sum(r["bytes"] for r in t.leaves.collect()) == sum(len(w) + 10 for w in WORDS)


def test_trie_of_any_text(spark, tmp_path):
    """Upper case, digits, signs, scripts beyond Latin: what the index answers is what a scan finds."""
    r = random.Random(2)
    letters = "abzABZ019 -~{|}_ÄßжД中文😀\u00e9e\u0301"
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randrange(0, 6)))) for i in range(600)]
    rows += [(1000 + i, w) for i, w in enumerate(["Zebra", "a~b", "x|y", "中文", "Yak", "zz", "{", "\U0010ffff"])] + [(2000, None)]
    df = spark.createDataFrame(rows, "id long, str string")
    t = build_index(df, Trie(resolution=6, blocksize=9), Names(str(tmp_path), "BasicTrie", "Trie", "u"), 1.0, parts=79, outside="overflow")
    known = [(i, w) for i, w in rows if w is not None]
    assert t.records().count() == len(rows)
    for w in ["a~b", "x|y", "中文", "Zebra", "", "{", "\U0010ffff", "nowhere"]:
        assert sorted(map(tuple, t.point(w).collect())) == sorted(x for x in known if x[1] == w)
        assert sorted(map(tuple, t.prefix(w[:1]).collect())) == sorted(x for x in known if x[1].startswith(w[:1]))
    for _ in range(25):
        lo, hi = r.choice(known)[1], r.choice(known)[1]
        want = sorted(x for x in known if min(lo, hi) <= x[1] <= max(lo, hi))
        assert sorted(map(tuple, t.range(lo, hi).collect())) == want
    assert [x["str"] for x in t.range("Y", "Zz").where("str in ('Zebra', 'Yak')").orderBy("str").collect()] == ["Yak", "Zebra"]


def test_string_functions(spark):
    df = spark.createDataFrame([("ab",), ("z",), ("",), (None,)], "str string")
    got = df.select(S.consistent(F.col("str"), F.lit("b"), F.lit(2)).alias("b"), S.consistent(F.col("str"), F.lit("-"), F.lit(2)).alias("e")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, True), (False, False)]
    codes = spark.createDataFrame([(c,) for c in "-az1A"], "c string").select(S.ordinal(F.col("c")).alias("i"), S.symbol(F.col("c")).alias("s")).collect()
    assert [r["i"] for r in codes] == [0, 1, 26, -1, -1] and [r["s"] for r in codes] == ["-", "a", "z", "-", "a"]
    assert S.interval_may_hold("b", "d", "d", "c") and not S.interval_may_hold("b", "d", "da", "x")
    assert S.interval_may_start("aa", "bz", "b") and S.interval_may_start("bcd", "bx", "bc") and not S.interval_may_start("bd", "bx", "bc")


def test_custom_family(spark, tmp_path):
    class East(Quad):
        """A quadtree over the eastern hemisphere."""

        def __init__(self, **params):
            super().__init__(world=Rect(0.0, -90.0, 180.0, 90.0), **params)

    register_index("East", East)
    df = spark.createDataFrame([(1, 10.0, 0.0), (2, 170.0, -80.0)], "id long, x double, y double")
    t = build_index(df, make_index("East", resolution=5), Names(str(tmp_path), "OSM", "East", "e"), 1.0, parts=4)
    assert [r["id"] for r in t.range((160, -90), (180, 0)).collect()] == [2]
    with pytest.raises(ValueError, match="no index"):
        make_index("none")


def test_grid(spark, points):
    assert [grid_side(n) for n in (1, 3, 4, 99, 100)] == [1, 1, 2, 9, 10]
    area = Rect(-90.0, -45.0, 90.0, 45.0)
    got = {r["id"]: (r["row"], r["col"]) for r in with_cell(points, area, 16).collect()}
    for i, x, y in some_points():
        inside = -90 <= x <= 90 and -45 <= y <= 45
        assert (i in got) == inside
        if inside:
            assert got[i] == (min(3, int((y + 45) // 22.5)), min(3, int((x + 90) // 45)))
    many = with_cell(points, Rect(-179.3, -90, 180, 89.9), 1_000_000).collect()
    edge = lambda lo, hi, v: next((i for i in range(999) if v < lo + (i + 1) * ((hi - lo) / 1000)), 999)
    assert all((p["row"], p["col"]) == (edge(-90, 89.9, p["y"]), edge(-179.3, 180, p["x"])) for p in many)
    one = with_cell(points, area, 1).select("row", "col").distinct().collect()
    assert [tuple(r) for r in one] == [(0, 0)]
    ids = collect_ids(points, area, 16).where("x = 10.5 and y = 10.5").first()["ids"].split(", ")
    assert len(ids) == 60 and ids == sorted(ids, key=int)
    with pytest.raises(ValueError):
        collect_ids(points, area, 16, group="y")


def test_command_line(spark, tmp_path):
    src = tmp_path / "in.txt"
    src.write_text('<node id="1" lat="1" lon="2"/>\n<node id="2" lat="50" lon="60"/>\n')
    cli.run(spark, ["build", "Quad", "OSM", str(src), "1", "--root", str(tmp_path / "idx")])
    cli.run(spark, ["query", "Quad", "OSM", str(src), "--root", str(tmp_path / "idx"), "--output", str(tmp_path / "q"), "0", "0", "10", "10"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "q")).collect()] == ["(X: 2.0 Y: 1.0, 1)"]
    area = ["--minlon", "0", "--minlat", "0", "--maxlon", "100", "--maxlat", "80"]
    cli.run(spark, ["scan", str(src), "--output", str(tmp_path / "s"), "--sort", *area])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()] == ["X: 2.0 Y: 1.0\t1", "X: 60.0 Y: 50.0\t2"]
    cli.run(spark, ["grid", str(src), "--output", str(tmp_path / "g"), "--cells", "4", *area])
    assert {tuple(r) for r in spark.read.text(str(tmp_path / "g")).collect()} == {("Lon: 2.0 Lat: 1.0\t1, ", 0, 0), ("Lon: 60.0 Lat: 50.0\t2, ", 1, 1)}
    with pytest.raises(SystemExit):
        cli.run(spark, ["query", "Quad", "OSM", str(src), "--root", "r", "--output", "o", "1"])
