"""The registered queries over the whole of their tables, and the same in DuckDB SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rects as R
from ..functions import strings as S
from ..operators import grid as G
from ..operators import planning as P
from ..operators import tree as TR
from ..operators.index import IndexedTable, Names, build_index, with_part
from ..operators.order import with_place
from ..operators.quad import Quad
from ..operators.scan import linear_scan, pair_lines, scan_lines, write_lines
from ..operators.trie import Trie
from ..sources import nodes as N
from ..sources.shared import shared_dir
from ..sources.views import POINTS_SQL, STRINGS_SQL, WORDS_SQL, points, strings, words

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The parameters of the registered queries.
RECT = (-60.0, -30.0, 45.5, 40.25)
SKINNY = (-170.0, 10.0, 170.0, 10.5)
DEPTH, PARTS, MORE_PARTS, AREA, CELLS = 40, 7, 28, R.Rect(-120.0, -60.0, 150.0, 75.0), 100
WORD_RANGE, PREFIX, TRIE_DEPTH, TRIE_BLOCK = ("mor", "pat"), "an", 50, 125
#: An index family other than the shipped presets, and ranges over strings of any alphabet.
SMALL_WORLD, TEXT_RANGE, TEXT_PREFIX = R.Rect(-100.0, -50.0, 130.0, 70.0), ("B", "s~"), "Un"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_p = f"with points as ({POINTS_SQL})"
_w = f"with words as ({WORDS_SQL})"


def _between(r) -> str:
    return f"x between {r[0]}e0 and {r[2]}e0 and y between {r[1]}e0 and {r[3]}e0"


# ---- sources -----------------------------------------------------------------------------------------------------


@query(f"{_p} select id, x, y from points")
def parse_osm_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return N.PointParser().parse(N.point_lines(points(spark, sf)))


@query(f"{_w} select id, str from words")
def parse_trie_nodes(spark, sf):
    return N.StringParser().parse(N.string_lines(words(spark, sf)))


@query(f"{_p} select case when id % 3 = 0 then 404 else id end as id, x, y from points")
def parse_bad_ids_404(spark, sf):
    spoiled = points(spark, sf).withColumn("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("n"), F.col("id").cast("string"))).otherwise(F.col("id").cast("string")))
    return N.PointParser().parse(N.point_lines(spoiled))


@query(f"{_p} select id, x, y from points union all select id + 1, y, x / 2 from points")
def parse_two_nodes_a_line(spark, sf):
    p = points(spark, sf)
    second = p.select((F.col("id") + 1).alias("id"), F.col("y").alias("x"), (F.col("x") / 2).alias("y"))
    both = p.withColumn("k", F.col("id")).join(second.select((F.col("id") - 1).alias("k"), F.struct("id", "x", "y").alias("b")), "k")
    lines = both.select(F.format_string('<way/><node id="%s" lat="%s" lon="%s"/> <node v="1" id="%s" lat="%s" lon="%s"></node>', *(F.col(c).cast("string") for c in ("id", "y", "x", "b.id", "b.y", "b.x"))).alias("value"))
    return N.PointParser().parse(lines)


@query(f"{_p} select id, x, y from points")
def read_text_nodes(spark, sf):
    """Lines written to a text folder, and scanned there."""
    path = f"{shared_dir(spark)}/lines-{zlib.crc32(sf.encode()):08x}"
    write_lines(N.point_lines(points(spark, sf)), path)
    return N.read_nodes(spark, path, N.PointParser())


@query(f"{_p} select id, x, y from points")
def parse_one_a_line(spark, sf):
    """A parser of one record a line: fields in a row."""
    lines = points(spark, sf).select(F.concat_ws("\t", "id", "x", "y").alias("value"))
    return N.make_parser("Fields").parse(lines)


# ---- index-free scans --------------------------------------------------------------------------------------------


@query(f"{_p} select id, x, y from points where {_between(RECT)}")
def range_linear(spark, sf):
    return linear_scan(points(spark, sf), R.Rect.corners(*RECT))


@query(f"{_p} select id, x, y from points where {_between(RECT)} order by x, y, id")
def range_linear_sorted(spark, sf):
    return linear_scan(points(spark, sf), R.Rect.corners(*RECT), sort=True)


@query(f"{_p} select 'X: ' || x || ' Y: ' || y || chr(9) || id as value from points where {_between(RECT)}")
def range_linear_text(spark, sf):
    return scan_lines(range_linear(spark, sf))


# ---- index -------------------------------------------------------------------------------------------------------


def quad_names(spark: SparkSession, sf: str) -> Names:
    return Names(f"{shared_dir(spark)}/indexes-{zlib.crc32(sf.encode()):08x}", "OSM", "Quad", "points")


def trie_names(spark: SparkSession, sf: str) -> Names:
    return Names(f"{shared_dir(spark)}/indexes-{zlib.crc32(sf.encode()):08x}", "BasicTrie", "Trie", "words")


_built: dict[tuple, IndexedTable] = {}


def _files(spark: SparkSession, sf: str, *tables: str) -> tuple:
    """What tells that a table's files are still the same."""
    each = [spark.read.parquet(f"{sf}/{t}.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect() for t in tables]
    return tuple(sorted(map(str, (r for rows in each for r in rows))))


def _index(spark: SparkSession, sf: str, name: str, tables: tuple[str, ...], build) -> IndexedTable:
    """An index built once for a session and the files of its input."""
    key = (spark.sparkContext.applicationId, name, _files(spark, sf, *tables))
    if key not in _built:
        _built[key] = build()
    return _built[key]


def quad_index(spark: SparkSession, sf: str) -> IndexedTable:
    """The index of the points, at the preset's full resolution."""
    return _index(spark, sf, "Quad", ("orders",), lambda: build_index(points(spark, sf), Quad(), quad_names(spark, sf), percent=1.0, parts=28))


def trie_index(spark: SparkSession, sf: str) -> IndexedTable:
    return _index(spark, sf, "Trie", ("documents",), lambda: build_index(words(spark, sf), Trie(), trie_names(spark, sf), percent=1.0, parts=53))


def _names(spark, sf, source: str, index: str = "Quad") -> Names:
    return Names(f"{shared_dir(spark)}/indexes-{zlib.crc32(sf.encode()):08x}", "OSM", index, source)


def parts_index(spark, sf, n: int) -> IndexedTable:
    return _index(spark, sf, f"Quad in {n}", ("orders",), lambda: build_index(points(spark, sf), Quad(), _names(spark, sf, f"points-in-{n}"), percent=1.0, parts=n))


def small_world_index(spark, sf) -> IndexedTable:
    """Another world, blocksize, depth and shrinking; what lies outside goes to the overflow part."""
    family = Quad(world=SMALL_WORLD, blocksize=30, resolution=20, path_shrink="TREE", node_shrink=False)
    return _index(spark, sf, "small world", ("orders",), lambda: build_index(points(spark, sf), family, _names(spark, sf, "small-world"), percent=25, parts=10, outside="overflow"))


def text_index(spark, sf) -> IndexedTable:
    return _index(spark, sf, "strings", ("part", "documents", "nation"), lambda: build_index(strings(spark, sf), Trie(blocksize=40), _names(spark, sf, "strings", "Trie"), percent=50, parts=79))


@query(f"{_p} select id, x, y from points where {_between(RECT)}")
def range_indexed(spark, sf):
    return quad_index(spark, sf).range(RECT[:2], RECT[2:])


@query(f"{_p} select id, x, y from points where {_between(RECT)}")
def range_reversed_corners(spark, sf):
    return quad_index(spark, sf).range((RECT[2], RECT[1]), (RECT[0], RECT[3]))


@query(f"{_p} select id, x, y from points where {_between(SKINNY)}")
def range_skinny_cross(spark, sf):
    return quad_index(spark, sf).range(SKINNY[:2], SKINNY[2:])


@query(f"{_p}, k as (select x, y from points order by id limit 1) select id, points.x, points.y from points, k where points.x = k.x and points.y = k.y")
def range_degenerate_point(spark, sf):
    first = points(spark, sf).orderBy("id").limit(1).first()
    return quad_index(spark, sf).point((first["x"], first["y"]))


@query(f"{_p} select id, x, y from points where x between 0.001e0 and 0.002e0 and y between 0.001e0 and 0.002e0")
def range_empty(spark, sf):
    return quad_index(spark, sf).range((0.001, 0.001), (0.002, 0.002))


@query(f"{_p} select '(X: ' || x || ' Y: ' || y || ', ' || id || ')' as value from points where {_between(RECT)}")
def range_result_text(spark, sf):
    return pair_lines(range_indexed(spark, sf))


@query(f"{_p} select count(*) as n, cast(sum(id) as bigint) as ids, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from points")
def index_keeps_all(spark, sf):
    return quad_index(spark, sf).records().agg(F.count("*").alias("n"), F.sum("id").alias("ids"), *(f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))))


@query(f"{_p} select id, x, y from points where {_between(RECT)}")
def range_custom_world(spark, sf):
    return small_world_index(spark, sf).range(RECT[:2], RECT[2:])


@query(f"{_p} select id, x, y from points")
def range_beyond_the_world(spark, sf):
    return small_world_index(spark, sf).range((-500, -500), (500, 500))


def _cells_sql(depth: int) -> str:
    """points with the path p of `depth` digits, halving bounds a level at a time."""
    out = [f"l0 as (select id, x, y, -180e0 as x0, 180e0 as x1, -90e0 as y0, 90e0 as y1, '' as p from points)"]
    for i in range(depth):
        mx, my = "(x0 + x1) / 2", "(y0 + y1) / 2"
        out.append(
            f"l{i + 1} as (select id, x, y, case when x < {mx} then x0 else {mx} end as x0, case when x < {mx} then {mx} else x1 end as x1, "
            f"case when y < {my} then y0 else {my} end as y0, case when y < {my} then {my} else y1 end as y1, "
            f"p || case when y < {my} then case when x < {mx} then '2' else '3' end else case when x < {mx} then '0' else '1' end end as p from l{i})"
        )
    return f"{_p}, " + ", ".join(out) + f", deep as (select p, count(*) as n from l{depth} group by p)"


# ---- partitions --------------------------------------------------------------------------------------------------

_quadrant = "case when y < 0 then case when x < 0 then 2 else 3 end else case when x < 0 then 0 else 1 end end"


@query(f"{_p} select cast({_quadrant} as int) as quadrant, count(*) as n from points group by 1")
def quadrant_histogram(spark, sf):
    return points(spark, sf).groupBy(Quad().path(1).cast("int").alias("quadrant")).agg(F.count("*").alias("n"))


@query(f"{_p} select id, cast({_quadrant} as int) as part_id from points")
def partition_assign(spark, sf):
    return with_part(points(spark, sf), Quad(), list("0123")).select("id", "part_id")


def _planned(spark, sf, n=PARTS):
    q = Quad()
    parts = P.plan_partitions(P.sample_keys(points(spark, sf), q, 1.0), q, n)
    rows = [(i, *(q.region(p)[c] for c in ("prefix", "x0", "x1", "y0", "y1")), n) for i, (p, n) in enumerate(parts)]
    return spark.createDataFrame(rows, "part_id int, prefix string, x0 double, x1 double, y0 double, y1 double, n long")


_greedy = f"""{_p}, keys as (select distinct x, y from points),
q as (select {_quadrant} as d, x, y from keys),
counts as (select d, count(q.x) as n from range(4) r(d) left join q using (d) group by d),
best as (select d from counts order by n desc, d limit 1),
bounds as (select d, case when d in (1, 3) then 0 else -180 end as x0, case when d in (2, 3) then -90 else 0 end as y0 from range(4) r(d)),
kids as (select b.d, c.d as k, x0 + case when c.d in (1, 3) then 90 else 0 end as x0, y0 + case when c.d in (2, 3) then 0 else 45 end as y0
    from bounds b join best using (d), range(4) c(d)),
regions as (select d * 10 as o, cast(d as varchar) as prefix, x0, x0 + 180 as x1, y0, y0 + 90 as y1 from bounds where d not in (select d from best)
    union all select d * 10 + k, d || '' || k, x0, x0 + 90, y0, y0 + 45 from kids),
counted as (select o, prefix, x0, x1, y0, y1, count(x) as n from regions left join keys on x >= x0 and (x < x1 or x1 = 180 and x = 180) and y >= y0 and (y < y1 or y1 = 90 and y = 90) group by all)
select cast(row_number() over (order by o) - 1 as int) as part_id, prefix, cast(x0 as double) as x0, cast(x1 as double) as x1, cast(y0 as double) as y0, cast(y1 as double) as y1, n from counted"""


@query(_greedy)
def greedy_partitions_100pct(spark, sf):
    return _planned(spark, sf)


@query(f"""{_greedy[: _greedy.rindex('select cast(row_number()')]}, numbered as (select cast(row_number() over (order by o) - 1 as int) as part_id, * from counted),
held as (select part_id, prefix, min(p.x) as a, max(p.x) as b, min(p.y) as c, max(p.y) as d from numbered join points p on x >= x0 and (x < x1 or x1 = 180 and x = 180) and y >= y0 and (y < y1 or y1 = 90 and y = 90) group by all)
select part_id, prefix from held where b >= {RECT[0]}e0 and a <= {RECT[2]}e0 and d >= {RECT[1]}e0 and c <= {RECT[3]}e0""")
def qualifying_partitions(spark, sf):
    """The parts that a rectangle query reads."""
    table = parts_index(spark, sf, PARTS)
    return table.partitions.where(F.col("part_id").isin(table.qualifying(RECT[:2], RECT[2:]))).select("part_id", "prefix")


@query(f"""with recursive {_cells_sql(DEPTH)[5:]}, prefixes as (select substr(p, 1, lv) as prefix, count(*) as n from deep, range(1, 16) r(lv) group by 1),
counts as (select map_from_entries(list((prefix, n))) as m from prefixes),
steps(k, parts) as (select 1, ['0', '1', '2', '3'] union all
    select k + 1, list_sort(list_concat(list_filter(parts, lambda p: p <> best), [best || '0', best || '1', best || '2', best || '3'])) from
    (select k, parts, list_sort(list_transform(parts, lambda p: (-coalesce(m[p], 0), p)))[1][2] as best from steps, counts where k < {(MORE_PARTS - 1) // 3}))
select cast(i - 1 as int) as part_id, parts[i] as prefix, coalesce(m[parts[i]], 0) as n from (select parts, unnest(range(1, len(parts) + 1)) as i from steps where k = {(MORE_PARTS - 1) // 3}), counts""")
def greedy_partitions_many(spark, sf):
    return _planned(spark, sf, MORE_PARTS).select("part_id", "prefix", "n")


@query("select true as known, true as once, true as about")
def sample_tenth(spark, sf):
    """A Bernoulli sample of 10 %: keys of the input, each once, about a tenth of them."""
    keys = P.sample_keys(points(spark, sf), Quad(), P.fraction_of(10)).withColumn("s", F.lit(1))
    every = points(spark, sf).select("x", "y").distinct().withColumn("p", F.lit(1))
    n = F.count("s")
    both = keys.join(every, ["x", "y"], "full")
    return both.agg((n == F.count(F.when(F.col("p").isNotNull(), F.col("s")))).alias("known"), (n == F.count_distinct(F.when(F.col("s").isNotNull(), F.struct("x", "y")))).alias("once"), (F.abs(n - F.count("p") / 10) < 4 * F.sqrt(F.count("p") * 0.09)).alias("about"))


@query(f"{_p} select distinct x, y from points")
def sample_distinct_100pct(spark, sf):
    return P.sample_keys(points(spark, sf), Quad(), P.fraction_of(1))


@query("select * from (values (4, 0, 4), (4, 1, 7), (4, 10, 28), (27, 0, 27), (27, 10, 27), (27, 11, 53)) v(fanout, blocks, n)")
def partition_numbers(spark, sf):
    given = [(4, 0), (4, 1), (4, 10), (27, 0), (27, 10), (27, 11)]
    return spark.createDataFrame([(f, b, P.n_partitions(b << 20, 1 << 20, f)) for f, b in given], "fanout int, blocks int, n int")


# ---- trees -------------------------------------------------------------------------------------------------------


def _leaves_sql(depth: int, block: int) -> str:
    """After deep: nodes (prefix, level, n) and leaves (leaf, level, n)."""
    return f""", nodes as (select substr(p, 1, lv) as prefix, cast(lv as int) as level, cast(sum(n) as bigint) as n from deep, range(0, {depth + 1}) r(lv) group by 1, 2),
leaves as (select prefix as leaf, level, n from nodes where level >= 1 and (n <= {block} or level = {depth})
    and (level = 1 or exists (select 1 from nodes u where u.level = nodes.level - 1 and u.prefix = substr(nodes.prefix, 1, nodes.level - 1) and u.n > {block})))"""


_tree = _cells_sql(DEPTH) + _leaves_sql(DEPTH, 100)


def _deep(spark, sf, depth=DEPTH):
    return TR.cells(points(spark, sf), Quad(), depth)


@query(f"{_tree} select leaf, level, n, n * 24 as bytes from leaves")
def leaf_occupancy(spark, sf):
    return TR.leaves(_deep(spark, sf), Quad())


@query(f"{_tree} select cast(substr(leaf, 1, 1) as int) as part_id, leaf, level, n, n * 24 as bytes from leaves")
def index_leaves(spark, sf):
    """The catalog of leaves of an index in four parts, the quadrants."""
    return parts_index(spark, sf, 4).leaves


@query(f"{_tree} select id, leaf from l{DEPTH} join leaves on starts_with(p, leaf)")
def leaf_assign(spark, sf):
    return TR.with_leaf(points(spark, sf), Quad()).select("id", "leaf")


@query(f"{_cells_sql(4)} select p as leaf, 4 as level, n from deep")
def fixed_depth_cells(spark, sf):
    return TR.leaves(_deep(spark, sf, 4), Quad(resolution=4, path_shrink="NEVER")).drop("bytes")


_inner = f"""{_tree}, inner_nodes as (select prefix, level, n from nodes where exists (select 1 from leaves where length(leaf) > nodes.level and starts_with(leaf, prefix)))
, kids as (select substr(prefix, 1, length(prefix) - 1) as up, count(*) as children from (select prefix from inner_nodes union all select leaf from leaves) where prefix <> '' group by 1)
, tree as (select prefix, level, n, children from inner_nodes join kids on prefix = up union all select leaf, level, n, 0 from leaves)"""


@query(f"{_inner} select prefix, level, n, children from tree")
def tree_nodes(spark, sf):
    return TR.nodes(_deep(spark, sf), Quad()).drop("bytes")


@query(f"{_inner} select prefix, level, n, children from tree where children <> 1 or prefix = ''")
def tree_shrink(spark, sf):
    return TR.nodes(_deep(spark, sf), Quad(path_shrink="TREE")).drop("bytes")


@query(f"""{_inner}, held as (select prefix, level, n, 4 as children from inner_nodes union all select leaf, level, n, 0 from leaves)
select prefix, level, n, cast(children as bigint) as children from held union all
select prefix || d, level + 1, 0, 0 from inner_nodes, range(4) r(d) where prefix || d not in (select prefix from held)""")
def all_children_counts(spark, sf):
    return TR.nodes(_deep(spark, sf), Quad(node_shrink=False)).drop("bytes")


@query(f"""{_inner}, below as (select u.prefix, count(*) as nodes from tree u join tree d on starts_with(d.prefix, u.prefix) group by 1)
select prefix, level, n, n * 24 + nodes * {R.NODE_BYTES + R.RECT_BYTES} as size from tree join below using (prefix)""")
def subtree_rollup(spark, sf):
    return TR.subtree_bytes(TR.nodes(_deep(spark, sf), Quad()), Quad())


@query(f"{_inner} select row_number() over (order by prefix) as place, prefix from tree")
def catalog_preorder(spark, sf):
    """All nodes, numbered as a preorder walk meets them."""
    return TR.preorder(TR.nodes(_deep(spark, sf), Quad()))


@query(f"{_inner} select row_number() over (order by least(children, 1), case when children > 0 then children else n end, prefix) as place, prefix, case when children > 0 then children else n end as size from tree")
def node_order(spark, sf):
    """Leaves by their records, then index nodes by their children."""
    size = F.when(F.col("children") > 0, F.col("children")).otherwise(F.col("n"))
    each = TR.nodes(_deep(spark, sf), Quad()).select(F.least("children", F.lit(1)).alias("kind"), size.alias("size"), "prefix")
    return with_place(each, "kind", "size", "prefix").select((F.col("place") + 1).alias("place"), "prefix", "size")


_bounds = " union all ".join(f"select distinct p as prefix, x0, x1, y0, y1 from l{i}" for i in range(DEPTH + 1))


@query(f"""{_inner}, bounds as ({_bounds})
select prefix, '{{' || children || ',[' || x0 || ',' || y0 || ',' || (x1 - x0) || ',' || (y1 - y0) || ']}}' as node,
'{{part-r-' || lpad(cast(level as varchar), 5, '0') || ',[' || x0 || ',' || y0 || ',' || (x1 - x0) || ',' || (y1 - y0) || ']}}' as reference from tree join bounds using (prefix)""")
def node_forms(spark, sf):
    """Nodes, and references to files, with the rectangles of their cells."""
    q = Quad()
    rect = R.rect_json(q.cell_of(F.col("prefix")))
    file = F.concat(F.lit("part-r-"), F.lpad(F.col("level").cast("string"), 5, "0"))
    return TR.nodes(_deep(spark, sf), q).select("prefix", R.node_json(F.col("children"), rect).alias("node"), R.node_json(file, rect).alias("reference"))


# ---- grid --------------------------------------------------------------------------------------------------------

_area = (AREA.x0, AREA.y0, AREA.x1, AREA.y1)
_side = G.grid_side(CELLS)


def _step_sql(v: str, lo: float, hi: float) -> str:
    step = (hi - lo) / _side
    return "(" + " + ".join(f"case when {v} >= {lo + i * step!r}e0 then 1 else 0 end" for i in range(1, _side)) + ")"


_placed = f"{_p}, placed as (select id, x, y, {_step_sql('y', AREA.y0, AREA.y1)} as \"row\", {_step_sql('x', AREA.x0, AREA.x1)} as col from points where {_between(_area)})"


@query(f'{_placed} select "row", col, "row" * {_side} + col as cell, count(*) as n from placed group by all')
def grid_cells(spark, sf):
    return G.with_cell(points(spark, sf), AREA, CELLS).groupBy("row", "col", "cell").agg(F.count("*").alias("n"))


@query(f"{_placed} select \"row\", col, x, y, string_agg(cast(id as varchar), ', ' order by id) as ids from placed group by all")
def grid_collect(spark, sf):
    return G.collect_ids(points(spark, sf), AREA, CELLS)


@query(f"{_placed} select \"row\", col, x, max(y) as y, string_agg(cast(id as varchar), ', ' order by id) as ids from placed group by \"row\", col, x")
def grid_collect_by_longitude(spark, sf):
    return G.collect_ids(points(spark, sf), AREA, CELLS, group="x")


_grid_text = f"{_placed}, c as (select \"row\", col, x, y, string_agg(cast(id as varchar), ', ' order by id) as ids from placed group by all) select \"row\", col, 'Lon: ' || x || ' Lat: ' || y || chr(9) || ids || ', ' as value from c"


@query(_grid_text)
def grid_written(spark, sf):
    """The grid's files, a folder for each row and column, read back."""
    path = f"{shared_dir(spark)}/grid-{zlib.crc32(sf.encode()):08x}"
    G.write_grid(grid_text(spark, sf), path)
    return spark.read.text(path)


@query(_grid_text)
def grid_text(spark, sf):
    return G.grid_lines(G.collect_ids(points(spark, sf), AREA, CELLS))


# ---- trie --------------------------------------------------------------------------------------------------------


@query(f"{_w} select id, str from words where str between '{WORD_RANGE[0]}' and '{WORD_RANGE[1]}'")
def trie_range(spark, sf):
    return trie_index(spark, sf).range(*WORD_RANGE)


@query(f"{STRINGS_SQL} select id, str from strings where str between '{TEXT_RANGE[0]}' and '{TEXT_RANGE[1]}'")
def trie_range_any_text(spark, sf):
    """Strings of any alphabet, with upper case, digits and signs."""
    return text_index(spark, sf).range(*TEXT_RANGE)


@query(f"{STRINGS_SQL} select id, str from strings where starts_with(str, '{TEXT_PREFIX}')")
def trie_prefix_any_text(spark, sf):
    return text_index(spark, sf).prefix(TEXT_PREFIX)


@query(f"{STRINGS_SQL}, k as (select max(str) as m from strings) select id, str from strings, k where str = m")
def trie_point_any_text(spark, sf):
    return text_index(spark, sf).point(strings(spark, sf).agg(F.max("str")).first()[0])


@query(f"{_w} select id, str from words where str = 'the'")
def trie_point(spark, sf):
    return trie_index(spark, sf).point("the")


@query(f"{_w} select id, str from words where starts_with(str, '{PREFIX}')")
def trie_prefix(spark, sf):
    return trie_index(spark, sf).prefix(PREFIX)


@query(f"{_w} select '(' || str || ', ' || id || ')' as value from words where str between '{WORD_RANGE[0]}' and '{WORD_RANGE[1]}'")
def trie_result_text(spark, sf):
    return pair_lines(trie_range(spark, sf))


_deep_words = f"{_w}, deep as (select rpad(str, {TRIE_DEPTH}, '-') as p, count(*) as n, sum(strlen(str) + 10) as bytes from words group by 1)"


@query(f"{_deep_words} select substr(p, 1, 3) as prefix, 3 as level, cast(sum(n) as bigint) as n from deep group by 1")
def trie_prefix_counts(spark, sf):
    return TR.prefix_counts(TR.cells(words(spark, sf), Trie(), TRIE_DEPTH), 3)


@query(f"{_deep_words}{_leaves_sql(TRIE_DEPTH, TRIE_BLOCK)} select leaf, level, leaves.n, cast(sum(bytes) as bigint) as bytes from leaves join deep on starts_with(p, leaf) group by all")
def trie_leaves(spark, sf):
    return TR.leaves(TR.cells(words(spark, sf), Trie(), TRIE_DEPTH), Trie())


@query(f"""{_w} select c as predicate, cast(count(str) as bigint) as n from (select substr('{S.SYMBOLS}', cast(i as int), 1) as c from range(1, 28) r(i))
left join words on substr(str, 2, 1) = c or (c = '-' and 2 > length(str)) group by c""")
def trie_children(spark, sf):
    """The 27 children of the second level and the words consistent with each."""
    counts = [F.count_if(S.consistent(F.col("str"), F.lit(c), F.lit(2))).alias(c) for c in S.SYMBOLS]
    return words(spark, sf).agg(*counts).select(F.explode(F.array(*(F.struct(F.lit(c).alias("predicate"), F.col(f"`{c}`").alias("n")) for c in S.SYMBOLS))).alias("s")).select("s.*")


@query(f"""{_w}, q as (select substr(str, 1, 1) as c, count(*) as n from words group by 1),
best as (select c from q order by n desc, c limit 1),
parts as (select substr('{S.SYMBOLS}', cast(i as int), 1) as prefix from range(1, 28) r(i) where substr('{S.SYMBOLS}', cast(i as int), 1) not in (select c from best)
    union all select c || substr('{S.SYMBOLS}', cast(i as int), 1) from best, range(1, 28) r(i)),
counted as (select prefix, count(str) as n from parts left join words on starts_with(rpad(str, 2, '-'), prefix) group by prefix)
select cast(row_number() over (order by prefix) - 1 as int) as part_id, prefix, n from counted""")
def trie_partitions(spark, sf):
    t = Trie()
    parts = P.plan_partitions(P.sample_keys(words(spark, sf), t, 1.0), t, 53)
    return spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(parts)], "part_id int, prefix string, n long")


@query(f"{_w} select str, str || '-' as stored, cast(strlen(str) + 2 as int) as bytes, cast(instr('{S.SYMBOLS}', substr(str, 1, 1)) - 1 as int) as first_ordinal, substr(str, 1, 1) as first_symbol from words")
def string_forms(spark, sf):
    c = F.substring("str", 1, 1)
    return words(spark, sf).select("str", S.terminated(F.col("str")).alias("stored"), R.string_bytes(F.col("str")).alias("bytes"), S.ordinal(c).alias("first_ordinal"), S.from_ordinal(S.ordinal(c)).alias("first_symbol"))


@query("select p_name as c, case when regexp_matches(lower(substr(p_name, 1, 1)), '^[a-z]$') then lower(substr(p_name, 1, 1)) else '-' end as symbol from part")
def char_normalise(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("c"), S.symbol(F.substring("p_name", 1, 1)).alias("symbol"))


# ---- rectangles and text forms -----------------------------------------------------------------------------------

#: Rectangles from points: the extents may be negative.
_rects_sql = f"{_p}, rects as (select id, x, y, cast(id % 41 - 20 as double) as w, cast(id % 23 - 11 as double) as h from points), ends as (select *, least(x, x + w) as x0, greatest(x, x + w) as x1, least(y, y + h) as y0, greatest(y, y + h) as y1 from rects)"


def _rects(spark, sf):
    return points(spark, sf).select("id", F.struct("x", "y", (F.col("id") % 41 - 20).cast("double").alias("w"), (F.col("id") % 23 - 11).cast("double").alias("h")).alias("r"))


@query(f"""{_rects_sql} select id, x0 <= -10 and 10 <= x1 and y0 <= -5 and 5 <= y1 as holds, -100 <= x0 and x1 <= 100 and -50 <= y0 and y1 <= 50 as inside,
x0 <= 100 and -100 <= x1 and y0 <= 50 and -50 <= y1 as touches, 0 between x0 and x1 and 0 between y0 and y1 as origin from ends""")
def rect_predicates(spark, sf):
    big = F.struct(*(F.lit(v).alias(k) for k, v in zip("xywh", (-100.0, -50.0, 200.0, 100.0))))
    small = F.struct(*(F.lit(v).alias(k) for k, v in zip("xywh", (10.0, 5.0, -20.0, -10.0))))
    r = F.col("r")
    return _rects(spark, sf).select("id", R.contains(r, small).alias("holds"), R.contains(big, r).alias("inside"), R.overlaps(r, big).alias("touches"), R.contains_point(r, F.lit(0.0), F.lit(0.0)).alias("origin"))


@query(f"{_rects_sql}, k as (select id, w * h as area, x, y from rects) select row_number() over (order by area, x, y, id) as place, id, area from k")
def rect_order(spark, sf):
    """All rectangles by area, x and y."""
    keys = _rects(spark, sf).select("id", *(k.alias(n) for k, n in zip(R.order_keys(F.col("r")), ("area", "x", "y"))))
    return with_place(keys, "area", "x", "y", "id").select((F.col("place") + 1).alias("place"), "id", "area")


@query(f"""{_rects_sql} select id, '[' || x || ',' || y || ',' || w || ',' || h || ']' as json, w as back_w, x0, x1 - x0 as normal_w,
'X: ' || x || ' Y: ' || y || ' H: ' || h || ' W: ' || w as text from ends""")
def rect_forms(spark, sf):
    r = F.col("r")
    out = _rects(spark, sf).select("id", "r", R.rect_json(r).alias("json"))
    return out.select("id", "json", R.rect_from_json(F.col("json"))["w"].alias("back_w"), R.normalised(r)["x"].alias("x0"), R.normalised(r)["w"].alias("normal_w"), R.rect_text(r).alias("text"))


@query(f"{_w} select row_number() over (order by str, cast(id as varchar)) as place, '(' || str || ', ' || id || ')' as pair from words")
def pair_order(spark, sf):
    """Pairs by the text of the first, then by that of the second."""
    each = words(spark, sf).select("str", F.col("id").cast("string").alias("second"))
    return with_place(each, "str", "second").select((F.col("place") + 1).alias("place"), R.pair_text(F.col("str"), F.col("second")).alias("pair"))


@query("""with c as (select substr(p_name, 1, 1) as c, count(*) as n from part group by 1 union all select substr(n_name, 2, 1), count(*) from nation group by 1)
select row_number() over (order by unicode(c), n) as place, c, 'Ch: ' || c as text, unicode(c) as code from c""")
def char_order(spark, sf):
    first = lambda t, name, at: spark.read.parquet(f"{sf}/{t}.parquet").groupBy(F.substring(name, at, 1).alias("c")).agg(F.count("*").alias("n"))
    chars = first("part", "p_name", 1).union(first("nation", "n_name", 2)).withColumn("code", S.char_code(F.col("c")))
    return with_place(chars, "code", "n").select((F.col("place") + 1).alias("place"), "c", S.char_text(F.col("c")).alias("text"), "code")


def _wrap(sql: str) -> str:
    """A number as 32 signed bits."""
    return f"((({sql}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"


@query(f"""{_w}, h as (select str, id, list_reduce(list_prepend(0::hugeint, list_transform(string_split(str, ''), lambda c: unicode(c)::hugeint)), lambda a, c: {_wrap("a * 31 + c")}) as first, {_wrap("xor(id, id >> 32)")} as second from words)
select str, cast(first as bigint) as string_hash, cast(second as bigint) as long_hash, cast({_wrap("(first + second) * second + first")} as bigint) as pair_hash from h""")
def hash_codes(spark, sf):
    first, second = S.string_hash(F.col("str")), S.long_hash(F.col("id"))
    return words(spark, sf).select("str", first.alias("string_hash"), second.alias("long_hash"), S.pair_hash(first, second).alias("pair_hash"))


@query(f"{_w} select str, cast(strlen(str) + 10 as bigint) as pair, 24 as point_pair, 32 as rect, 2 as character from words")
def byte_sizes(spark, sf):
    return words(spark, sf).select("str", R.pair_bytes(R.string_bytes(F.col("str"))).cast("long").alias("pair"), R.pair_bytes(R.POINT_BYTES).alias("point_pair"), F.lit(R.RECT_BYTES).alias("rect"), F.lit(R.CHAR_BYTES).alias("character"))


@query(f"{_p} select id, x between least(y, 0) and greatest(y, 0) and y between least(x, 10e0) and greatest(x, 10e0) as hit from points")
def corners_in_columns(spark, sf):
    c = F.col
    return points(spark, sf).select("id", R.in_corners(c("x"), c("y"), F.lit(0.0), c("x"), c("y"), F.lit(10.0)).alias("hit"))


@query("select l_orderkey as k, cast(regexp_extract('Local/part-r-' || lpad(cast(l_orderkey as varchar), 12, '0'), '-([0-9]+)$', 1) as int) as number, 'part-r-' || lpad(cast(l_orderkey as varchar), 12, '0') as segment from lineitem")
def file_names(spark, sf):
    file = F.concat(F.lit("Local/part-r-"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"))
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), S.file_number(file).alias("number"), S.last_segment(file).alias("segment"))
