"""All queries of the library by name, and their DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..functions import tables as T
from ..operators import clean, dataset, evaluate, geodesy, graph, labels, learn, sampling, spatial, views, voxels
from ..session import new_path, written
from ..sources import adapters as A
from ..sources import clouds as cloud_files
from ..sources import chunks, las, manifest, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SIZE, VOXEL, EDGE_VOXEL, RADIUS, TILE, OVERLAP, SPACING, CLASSES, POINTS, TILE_POINTS = 64, 4.0, 20.0, 40.0, 100.0, 0.4, 10.0, 10, 64, 16
LAS_POINTS, LAS_SPLIT = 50_000, 1 << 16
SHORTEST, CHAIN_SPACING = 60.0, 50.0
AXES = "xyz"


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Rounds columns, so that sums in another order compare equal; minus zero becomes zero."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names or [c for c, t in df.dtypes if t == "double"]})


def query(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n.rpartition('.')[2]}" for n in names)


def u(seed: str, *keys: str) -> str:
    """The SQL of rng.uniform."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def b(seed: str, low: float, high: float, *keys: str) -> str:
    return f"({low}::DOUBLE + {high - low}::DOUBLE * {u(seed, *keys)})"


def normal(seed: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {u(seed + 'a', *keys)})) * cos(6.283185307179586::DOUBLE * {u(seed + 'b', *keys)}))"


LI, EV, CL, SC = f"li AS ({A.LINE_POINTS})", f"ev AS ({A.EVENT_POINTS})", f"cl AS ({A.CLOUDS})", f"sc AS ({A.SCORES})"


# Views


def _views_sql(cube: str) -> str:
    g = "\n".join(f", greatest(0, least({SIZE - 1}, trunc(({a} - lo{a}) / (hi{a} - lo{a} + 1e-8::DOUBLE) * {SIZE - 1})::INT)) AS g{a}" for a in AXES)
    last = SIZE - 1
    made = [("top", "gy", "gx", "hiz - z"), ("front", f"{last} - gz", "gx", "hiy - y"), ("back", f"{last} - gz", f"{last} - gx", "y - loy"), ("left", f"{last} - gz", "gy", "hix - x"), ("right", f"{last} - gz", f"{last} - gy", "x - lox")]
    union = " UNION ALL ".join(f"SELECT cloud_id, '{v}' AS view, {p} AS \"row\", {q} AS col, {d} AS d FROM g" for v, p, q, d in made)
    return f"""WITH {LI},
bb AS (SELECT cloud_id, {', '.join(f'min({a}) AS n{a}, max({a}) AS m{a}' for a in AXES)} FROM {cube} GROUP BY 1),
hh AS (SELECT *, greatest(mx - nx, my - ny, mz - nz) / 2 * (1 + 2 * 0.05::DOUBLE) AS h FROM bb),
cc AS (SELECT cloud_id, {', '.join(f'(n{a} + m{a}) / 2 - h AS lo{a}, (n{a} + m{a}) / 2 + h AS hi{a}' for a in AXES)} FROM hh),
g AS (SELECT li.*, cc.* EXCLUDE (cloud_id) {g} FROM li JOIN cc USING (cloud_id)),
px AS (SELECT cloud_id, view, "row", col, min(d) AS d FROM ({union}) GROUP BY ALL),
vw AS (SELECT cloud_id, view, "row", col, (max(d) OVER w - d) / (max(d) OVER w - min(d) OVER w + 1e-8::DOUBLE) * (254::DOUBLE / 255) + 1::DOUBLE / 255 AS value FROM px WINDOW w AS (PARTITION BY cloud_id, view))"""


_OTHER = "(SELECT CASE WHEN cloud_id = (SELECT max(cloud_id) FROM li) THEN (SELECT min(cloud_id) FROM li) ELSE cloud_id + 1 END AS cloud_id, x, y, z FROM li)"


def _reference(spark: SparkSession, d: str) -> DataFrame:
    """Each cloud's cube is that of the cloud before it."""
    p = A.line_points(spark, d)
    other = p.crossJoin(F.broadcast(p.agg(F.min("cloud_id").alias("lo"), F.max("cloud_id").alias("hi"))))  # one row
    return views.project(p, SIZE, other.select(F.when(F.col("cloud_id") == F.col("hi"), F.col("lo")).otherwise(F.col("cloud_id") + 1).alias("cloud_id"), "x", "y", "z"))


query("side_views", lambda s, d: rounded(views.project(A.line_points(s, d), SIZE)), f"{_views_sql('li')} SELECT cloud_id, view, \"row\", col, {r('value')} FROM vw")
query("side_views_ref_cube", lambda s, d: rounded(_reference(s, d)), f"{_views_sql(_OTHER)} SELECT cloud_id, view, \"row\", col, {r('value')} FROM vw")
_W = ", ".join(f"({i - 2}, {w!r}::DOUBLE)" for i, w in enumerate(views.kernel()))
query(
    "gaussian_blur",
    lambda s, d: rounded(views.blur(views.project(A.line_points(s, d), SIZE), SIZE)),
    f"""{_views_sql('li')}, k(d, w) AS (VALUES {_W}), t AS (SELECT i AS pos, d, w, CASE WHEN i + d < 0 THEN -(i + d) WHEN i + d > {SIZE - 1} THEN {2 * (SIZE - 1)} - (i + d) ELSE i + d END AS src FROM range({SIZE}) q(i), k)
SELECT cloud_id, view, a.pos::INT AS "row", c.pos::INT AS col, round(sum(value * a.w * c.w), 6) + 0.0 AS value FROM vw JOIN t a ON a.src = vw."row" JOIN t c ON c.src = vw.col GROUP BY ALL""",
)

# Cleaning

_BOX = f"bx AS (SELECT cloud_id, {', '.join(f'min({a}) AS min_{a}, max({a}) AS max_{a}, avg({a}) AS mean_{a}' for a in AXES)}, count(*) AS n FROM ev GROUP BY 1)"
_XYZ = r("x", "y", "z", digits=9)
query("center_cloud", lambda s, d: rounded(clean.center(A.event_points(s, d)), 9), f"WITH {EV}, {_BOX} SELECT cloud_id, point_id, {', '.join(f'round({a} - mean_{a}, 9) + 0.0 AS {a}' for a in AXES)} FROM ev JOIN bx USING (cloud_id)")
query("cloud_bbox", lambda s, d: rounded(clean.bbox(A.event_points(s, d))), f"WITH {EV}, {_BOX} SELECT cloud_id, {r(*(f'{m}_{a}' for a in AXES for m in ('min', 'max')))}, {', '.join(f'round((min_{a} + max_{a}) / 2, 6) AS mid_{a}' for a in AXES)}, round(greatest(max_x - min_x, max_y - min_y, max_z - min_z) / 2 * 1.1::DOUBLE, 6) AS half, n FROM bx")
_UNIT = ", ".join(f"(({a} - min_{a}) / greatest(max_{a} - min_{a}, 1e-6::DOUBLE))" + " AS {}" + a for a in AXES)
query("unit_normalize", lambda s, d: rounded(clean.unit(A.event_points(s, d)), 9), f"WITH {EV}, {_BOX}, un AS (SELECT cloud_id, point_id, {_UNIT.format('', '', '')} FROM ev JOIN bx USING (cloud_id)) SELECT cloud_id, point_id, {_XYZ} FROM un")
query("safe_points", lambda s, d: clean.safe(A.event_points(s, d), 60), f"WITH {EV} SELECT * FROM ev WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND cloud_id IN (SELECT cloud_id FROM ev WHERE isfinite(x) AND isfinite(y) AND isfinite(z) GROUP BY 1 HAVING count(*) >= 60)")
query("tree_height_filter", lambda s, d: clean.tall(A.event_points(s, d), 97.5), f"WITH {EV} SELECT * FROM ev WHERE cloud_id IN (SELECT cloud_id FROM ev GROUP BY 1 HAVING max(z) - min(z) >= 97.5)")
query("tree_height_dryrun", lambda s, d: clean.short(A.event_points(s, d), 97.5), f"WITH {EV} SELECT cloud_id, max(z) - min(z) AS height FROM ev GROUP BY 1 HAVING max(z) - min(z) < 97.5")


def _plots(s: SparkSession, d: str) -> DataFrame:
    return A.event_points(s, d).select((F.col("cloud_id") % 60).alias("tree_id"), "point_id", (F.col("z") % 4).cast("int").alias("species"), *AXES)


query(
    "drop_background",
    lambda s, d: clean.drop_background(_plots(s, d)),
    f"WITH {EV}, pl AS (SELECT cloud_id % 60 AS tree_id, point_id, (z % 4)::INT AS species, x, y, z FROM ev), fs AS (SELECT tree_id, arg_min(species, point_id) AS first_species FROM pl GROUP BY 1) SELECT pl.*, first_species FROM pl JOIN fs USING (tree_id) WHERE tree_id <> 0 AND first_species <> 0",
)

# Voxels and tiles


def _keys(size: float) -> str:
    return ", ".join(f"floor({a} / {size}::DOUBLE)::BIGINT AS k{a}" for a in AXES)


query("voxel_mean", lambda s, d: rounded(voxels.means(A.line_points(s, d), VOXEL), 9), f"WITH {LI}, v AS (SELECT cloud_id, {_keys(VOXEL)}, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM li GROUP BY ALL) SELECT cloud_id, kx, ky, kz, {_XYZ}, n FROM v")
_D2 = " + ".join(f"pow({a} / {VOXEL}::DOUBLE - floor({a} / {VOXEL}::DOUBLE) - 0.5, 2)" for a in AXES)
query(
    "voxel_top1",
    lambda s, d: voxels.nearest(A.line_points(s, d), VOXEL),
    f"WITH {LI}, v AS (SELECT *, {_keys(VOXEL)}, round({_D2}, 12) AS d2 FROM li), n AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, kx, ky, kz ORDER BY d2, x, y, z) AS i FROM v) SELECT cloud_id, kx, ky, kz, x, y, z FROM n WHERE i = 1",
)
_STRIDE = f"({TILE}::DOUBLE * (1 - {OVERLAP}::DOUBLE))"


def _steps(a: str) -> str:
    return f"unnest(generate_series(0, ceil((hi{a} - lo{a}) / {_STRIDE})::BIGINT)) AS i{a}"


query(
    "overlap_tiles",
    lambda s, d: voxels.tiles(A.event_points(s, d), TILE, OVERLAP),
    f"""WITH {EV}, bx AS (SELECT cloud_id, min(x) AS lox, max(x) AS hix, min(y) AS loy, max(y) AS hiy FROM ev GROUP BY 1), tx AS (SELECT *, {_steps('x')} FROM bx), tt AS (SELECT *, {_steps('y')} FROM tx)
SELECT cloud_id, point_id, ix::INT AS ix, iy::INT AS iy FROM ev JOIN tt USING (cloud_id) WHERE x BETWEEN lox + ix * {_STRIDE} AND lox + ix * {_STRIDE} + {TILE}::DOUBLE AND y BETWEEN loy + iy * {_STRIDE} AND loy + iy * {_STRIDE} + {TILE}::DOUBLE""",
)


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return rounded(voxels.means(A.event_points(s, d), EDGE_VOXEL), 9)


def _edges(s: SparkSession, d: str) -> DataFrame:
    return rounded(voxels.radius_edges(_nodes(s, d), EDGE_VOXEL, RADIUS))


_STEPS = ", ".join(map(str, voxels.offsets(EDGE_VOXEL, RADIUS)))
_EDGES = f"""WITH {EV}, nd AS (SELECT cloud_id, kx, ky, kz, kx || '_' || ky || '_' || kz AS node, {_XYZ} FROM (SELECT cloud_id, {_keys(EDGE_VOXEL)}, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM ev GROUP BY ALL)),
st(dx, dy, dz) AS (VALUES {_STEPS}),
pr AS (SELECT p.cloud_id, p.node AS src, q.node AS dst, p.x AS ax, p.y AS ay, p.z AS az, q.x AS qx, q.y AS qy, q.z AS qz, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z) AS d2
  FROM nd p, st JOIN nd q ON q.cloud_id = p.cloud_id AND q.kx = p.kx + dx AND q.ky = p.ky + dy AND q.kz = p.kz + dz),
ed AS (SELECT cloud_id, src, dst, round(d2, 6) AS d2, ax, ay, az, qx, qy, qz FROM pr WHERE d2 <= {RADIUS * RADIUS}::DOUBLE),
bo AS (SELECT cloud_id, src AS node, dst AS other FROM ed UNION ALL SELECT cloud_id, dst, src FROM ed)"""
query("radius_edges", _edges, f"{_EDGES} SELECT cloud_id, src, dst, d2 FROM ed")
query("node_degree", lambda s, d: voxels.degrees(_edges(s, d)), f"{_EDGES} SELECT cloud_id, node, count(*) AS degree FROM bo GROUP BY ALL")
query("adjacency", lambda s, d: voxels.adjacency(_edges(s, d)).withColumn("neighbours", F.array_join("neighbours", " ")), f"{_EDGES} SELECT cloud_id, node, string_agg(other, ' ' ORDER BY other) AS neighbours FROM bo GROUP BY ALL")
query(
    "sample_edges",
    lambda s, d: rounded(voxels.along_edges(_edges(s, d), _nodes(s, d), SPACING)),
    f"""{_EDGES}, ln AS (SELECT *, greatest(2, ceil(sqrt((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay) + (qz - az) * (qz - az)) / {SPACING}::DOUBLE)::INT + 1) AS n FROM ed), sp AS (SELECT *, unnest(generate_series(0, n - 1)) AS step FROM ln)
SELECT cloud_id, src, dst, step::INT AS step, {', '.join(f'round(a{a} + step::DOUBLE / (n - 1) * (q{a} - a{a}), 6) + 0.0 AS {a}' for a in AXES)} FROM sp""",
)
query(
    "sample_skeleton",
    lambda s, d: rounded(voxels.skeleton(_edges(s, d), _nodes(s, d), SPACING)),
    f"{SQL['sample_edges']} UNION ALL SELECT cloud_id, node, NULL, -1, {', '.join(f'round({a}, 6) + 0.0' for a in AXES)} FROM nd",
)


def _alive(s: SparkSession, d: str) -> DataFrame:
    return voxels.alive_edges(_edges(s, d), voxels.degrees(_edges(s, d)).where("degree >= 4").select("cloud_id", "node"))


_ALIVE = "(SELECT cloud_id, node FROM bo GROUP BY ALL HAVING count(*) >= 4)"
query("alive_edge_filter", _alive, f"{_EDGES} SELECT cloud_id, src, dst, d2 FROM ed WHERE (cloud_id, src) IN {_ALIVE} AND (cloud_id, dst) IN {_ALIVE}")
_FOREST = f"""{_EDGES.replace("WITH", "WITH RECURSIVE", 1)}, ra AS (SELECT cloud_id, src, dst, d2, row_number() OVER (PARTITION BY cloud_id ORDER BY d2, src, dst) AS i FROM ed),
ba AS (SELECT cloud_id, i, src AS node, dst AS other FROM ra UNION ALL SELECT cloud_id, i, dst, src FROM ra),
re AS (SELECT cloud_id, i, src AS node FROM ra UNION SELECT re.cloud_id, re.i, other FROM re JOIN ba ON ba.cloud_id = re.cloud_id AND ba.node = re.node AND ba.i < re.i),
fo AS (SELECT cloud_id, src, dst, d2 FROM ra WHERE (cloud_id, i, dst) NOT IN (SELECT cloud_id, i, node FROM re))"""
#: Pruning node by node: a row is a cloud with its dead nodes, the leaves of the round that are still to come, and the path that is being followed.
_alive_of = "list_filter({}, lambda o: NOT list_contains(dead, o.n))".format
_PRUNED = f"""{_FOREST}, fb AS (SELECT cloud_id, src AS node, dst AS other, sqrt(d2) AS w FROM fo UNION ALL SELECT cloud_id, dst, src, sqrt(d2) FROM fo),
gr AS (SELECT cloud_id, map_from_entries(list((node, os))) AS m, list(node ORDER BY kx, ky, kz) AS nodes FROM (SELECT cloud_id, node, list({{'n': other, 'w': w}}) AS os FROM fb GROUP BY ALL) JOIN nd USING (cloud_id, node) GROUP BY 1),
ps AS (SELECT cloud_id, []::VARCHAR[] AS dead, []::VARCHAR[] AS queue, []::VARCHAR[] AS path, 0::DOUBLE AS far, true AS changed, false AS done FROM gr UNION ALL
  SELECT cloud_id, CASE WHEN ends AND far2 < {SHORTEST} THEN dead || path2[:-2] ELSE dead END, CASE WHEN len(path) > 0 THEN queue WHEN len(queue) > 0 THEN queue[2:] WHEN changed THEN list_filter(nodes, lambda v: NOT list_contains(dead, v) AND len({_alive_of('m[v]')}) = 1) ELSE queue END,
    CASE WHEN len(path) > 0 THEN CASE WHEN ends THEN []::VARCHAR[] ELSE path2 END WHEN len(queue) > 0 AND NOT list_contains(dead, queue[1]) THEN [queue[1]] ELSE []::VARCHAR[] END, CASE WHEN len(path) > 0 AND NOT ends THEN far2 ELSE 0 END,
    CASE WHEN len(path) > 0 THEN changed OR (ends AND far2 < {SHORTEST} AND len(path2) > 1) ELSE changed AND len(queue) > 0 END, len(path) = 0 AND len(queue) = 0 AND NOT changed
  FROM (SELECT *, len(path) > 0 AND (step IS NULL OR far2 >= {SHORTEST} OR len({_alive_of('m[step.n]')}) <> 2) AS ends FROM (SELECT *, far + coalesce(step.w, 0) AS far2, CASE WHEN step IS NULL THEN path ELSE list_append(path, step.n) END AS path2
    FROM (SELECT *, CASE WHEN len(path) > 0 THEN list_filter({_alive_of('m[path[-1]]')}, lambda o: len(path) = 1 OR o.n <> path[-2])[1] END AS step FROM ps JOIN gr USING (cloud_id) WHERE NOT done)))),
pn AS (SELECT fo.* FROM fo JOIN ps USING (cloud_id) WHERE done AND NOT list_contains(dead, src) AND NOT list_contains(dead, dst))"""
#: Simplification by a walk from each end or fork along each chain; of the two walks of a chain, the one from the end that comes first counts.
_SIMPLIFIED = f"""{_PRUNED}, pb AS (SELECT cloud_id, src AS node, dst AS other, sqrt(d2) AS w FROM pn UNION ALL SELECT cloud_id, dst, src, sqrt(d2) FROM pn), fx AS (SELECT cloud_id, node FROM pb GROUP BY ALL HAVING count(*) <> 2),
wk AS (SELECT cloud_id, node AS start, other AS first, node AS kept, node AS back, other AS node, w AS far, NULL::VARCHAR AS put, (cloud_id, other) IN (SELECT cloud_id, node FROM fx) AS over FROM pb WHERE (cloud_id, node) IN (SELECT cloud_id, node FROM fx) UNION ALL
  SELECT k.cloud_id, start, first, CASE WHEN far >= {CHAIN_SPACING} THEN k.node ELSE kept END, k.node, p.other, CASE WHEN far >= {CHAIN_SPACING} THEN 0 ELSE far END + p.w, CASE WHEN far >= {CHAIN_SPACING} THEN kept END, (k.cloud_id, p.other) IN (SELECT cloud_id, node FROM fx) FROM wk k JOIN pb p ON p.cloud_id = k.cloud_id AND p.node = k.node AND p.other <> k.back WHERE NOT over),
ch AS (SELECT w.cloud_id, start, first FROM wk w JOIN nd a ON a.cloud_id = w.cloud_id AND a.node = start JOIN nd b ON b.cloud_id = w.cloud_id AND b.node = w.node WHERE over AND (a.kx, a.ky, a.kz) < (b.kx, b.ky, b.kz)),
sg AS (SELECT cloud_id, put AS a, back AS b FROM wk SEMI JOIN ch USING (cloud_id, start, first) WHERE put IS NOT NULL UNION SELECT cloud_id, kept, node FROM wk SEMI JOIN ch USING (cloud_id, start, first) WHERE over)"""
query("min_spanning_forest", lambda s, d: graph.spanning_forest(_edges(s, d)), f"{_FOREST} SELECT * FROM fo")
query("min_spanning_forest_rounds", lambda s, d: graph.spanning_forest(_edges(s, d), 0), SQL["min_spanning_forest"])


def _pruned(s: SparkSession, d: str, most: int = graph.GROUP_EDGES) -> DataFrame:
    return graph.prune(graph.spanning_forest(_edges(s, d)), SHORTEST, most)


def _simplified(s: SparkSession, d: str, most: int = graph.GROUP_EDGES) -> DataFrame:
    return rounded(graph.simplify(_pruned(s, d), _nodes(s, d), CHAIN_SPACING, most))


query("prune_branches", _pruned, f"{_PRUNED} SELECT * FROM pn")
query("prune_branches_by_chains", lambda s, d: _pruned(s, d, 0), SQL["prune_branches"])
query(
    "simplify_chains",
    _simplified,
    f"{_SIMPLIFIED} SELECT cloud_id, CASE WHEN f THEN p.node ELSE q.node END AS src, CASE WHEN f THEN q.node ELSE p.node END AS dst, round((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z), 6) + 0.0 AS d2 FROM (SELECT sg.cloud_id, p, q, (p.kx, p.ky, p.kz) < (q.kx, q.ky, q.kz) AS f FROM sg JOIN nd p ON p.cloud_id = sg.cloud_id AND p.node = a JOIN nd q ON q.cloud_id = sg.cloud_id AND q.node = b)",
)
query("simplify_chains_across", lambda s, d: _simplified(s, d, 0), SQL["simplify_chains"])

# Labels and splits

_MERGED = "me AS (SELECT cloud_id, path, CASE WHEN m IN ('Plain', 'Special', 'LARGE') THEN m ELSE 'others' END AS species FROM (SELECT *, CASE species WHEN 'ECONOMY' THEN 'Plain' WHEN 'STANDARD' THEN 'Plain' WHEN 'PROMO' THEN 'Special' ELSE species END AS m FROM cl))"
_RANKS = "rk AS (SELECT species, (row_number() OVER (ORDER BY species = 'others', species) - 1)::INT AS species_number FROM (SELECT DISTINCT species FROM me))"
_PARSED = r"pa AS (SELECT *, regexp_extract(regexp_extract(path, '([^/]*)\.npy$', 1), '^(.*)_[^_]*$', 1) AS stem, try_cast(nullif(regexp_extract(path, '_([0-9]+)\.npy$', 1), '') AS INT) AS label FROM cl)"


def _merged(s: SparkSession, d: str) -> DataFrame:
    return labels.merged(A.clouds(s, d), T.MERGE, T.ALLOWED)


def _split(s: SparkSession, d: str) -> DataFrame:
    return labels.split(labels.parsed(A.clouds(s, d)), "species")


query("merge_species", _merged, f"WITH {CL}, {_MERGED} SELECT cloud_id, species, path FROM me")
query("label_encode", lambda s, d: labels.encoded(_merged(s, d)).select("cloud_id", "species", "species_number"), f"WITH {CL}, {_MERGED}, {_RANKS} SELECT cloud_id, species, species_number FROM me JOIN rk USING (species)")
query("label_encode_strings", lambda s, d: labels.encoded(labels.parsed(A.clouds(s, d)).withColumn("name", F.col("label").cast("string")), "name").select("cloud_id", "name", "species_number"), f"WITH {CL}, {_PARSED}, nm AS (SELECT cloud_id, label::VARCHAR AS name FROM pa), rk AS (SELECT name, (row_number() OVER (ORDER BY name) - 1)::INT AS species_number FROM (SELECT DISTINCT name FROM nm)) SELECT * FROM nm JOIN rk USING (name)")
query("species_counts", lambda s, d: labels.counts(labels.encoded(_merged(s, d))), f"WITH {CL}, {_MERGED}, {_RANKS} SELECT species, species_number, count(*) AS \"count\" FROM me JOIN rk USING (species) GROUP BY ALL")
query("parse_label", lambda s, d: labels.parsed(A.clouds(s, d)), f"WITH {CL}, {_PARSED} SELECT * FROM pa")
query("swap_labels", lambda s, d: labels.swapped(A.clouds(s, d), 15, 16), rf"WITH {CL} SELECT cloud_id, species, CASE regexp_extract(path, '_([0-9]+)\.npy$', 1) WHEN '15' THEN regexp_replace(path, '[0-9]+\.npy$', '16.npy') WHEN '16' THEN regexp_replace(path, '[0-9]+\.npy$', '15.npy') ELSE path END AS path FROM cl")
query(
    "label_join_default",
    lambda s, d: labels.labelled(labels.parsed(A.clouds(s, d)).select("cloud_id", "stem"), labels.encoded(_merged(s, d)).select(F.regexp_extract("path", "^(.*)_[^_]*$", 1).alias("stem"), "species_number", F.col("cloud_id").alias("seq"))),
    rf"WITH {CL}, {_PARSED}, {_MERGED}, {_RANKS}, md AS (SELECT regexp_extract(path, '^(.*)_[^_]*$', 1) AS stem, arg_max(species_number, cloud_id) AS species_number FROM me JOIN rk USING (species) GROUP BY 1) SELECT cloud_id, stem, coalesce(species_number, 15) AS species_number FROM pa LEFT JOIN md USING (stem)",
)
query(
    "name_join_default",
    lambda s, d: labels.named(labels.parsed(A.clouds(s, d)).select("cloud_id", "label"), labels.parsed(A.clouds(s, d)).select("label", F.col("species").alias("name"), F.col("cloud_id").alias("seq"))),
    f"WITH {CL}, {_PARSED}, nm AS (SELECT label, arg_min(species, cloud_id) AS name FROM pa GROUP BY 1) SELECT cloud_id, label, coalesce(name, 'species_' || label) AS name FROM pa LEFT JOIN nm USING (label)",
)
query("ignore_index_filter", lambda s, d: A.scores(s, d).where("label < 7").select("id", "label"), f"WITH {SC} SELECT id, label FROM sc WHERE label < 7")
_SPLIT = f"""{_PARSED}, so AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY {u('split', 'cloud_id')}, cloud_id) AS p, count(*) OVER (PARTITION BY species) AS n FROM pa),
sb AS (SELECT *, floor(n * 0.7::DOUBLE + 0.5) AS qa FROM so), sq AS (SELECT *, qa + floor((n - qa) * (2::DOUBLE / 3) + 0.5) AS qb FROM sb),
sp AS (SELECT cloud_id, species, path, stem, label, CASE WHEN p <= qa THEN 'train' WHEN p <= qb THEN 'test' ELSE 'val' END AS split FROM sq)"""
query("stratified_split", _split, f"WITH {CL}, {_SPLIT} SELECT * FROM sp")
query("split_guard", lambda s, d: labels.can_stratify(labels.parsed(A.clouds(s, d)), "label"), f"WITH {CL}, {_PARSED} SELECT min(n) >= 2 AS stratify, min(n) AS least FROM (SELECT count(*) AS n FROM pa GROUP BY label)")
query("metadata_b", lambda s, d: labels.metadata_files(_split(s, d)), f"WITH {CL}, {_SPLIT} SELECT (row_number() OVER (ORDER BY path, cloud_id) - 1)::INT AS file_num, path AS file_name, label, species, split AS folder_name FROM sp")
query("metadata_a_pivot", lambda s, d: labels.metadata_counts(_split(s, d)), f"WITH {CL}, {_SPLIT} SELECT label, species, count_if(split = 'train')::BIGINT AS count_train, count_if(split = 'test')::BIGINT AS count_test, count_if(split = 'val')::BIGINT AS count_val FROM sp GROUP BY ALL")
query("chunk_ids", lambda s, d: voxels.chunk_ids(_split(s, d), ["path", "cloud_id"]).select("cloud_id", "split", "chunk_id"), f"WITH {CL}, {_SPLIT} SELECT cloud_id, split, ((row_number() OVER (PARTITION BY split ORDER BY path, cloud_id) - 1) // 30)::BIGINT AS chunk_id FROM sp")


def _uneven(s: SparkSession, d: str) -> DataFrame:
    return A.clouds(s, d).select("cloud_id", F.when(F.col("cloud_id") % 10 < 8, "train").when(F.col("cloud_id") % 10 == 8, "test").otherwise("val").alias("split"))


query(
    "rebalance_split",
    lambda s, d: labels.rebalanced(_uneven(s, d)),
    f"""WITH un AS (SELECT p_partkey AS cloud_id, CASE WHEN p_partkey % 10 < 8 THEN 'train' WHEN p_partkey % 10 = 8 THEN 'test' ELSE 'val' END AS split FROM part),
w(split, want, place) AS (VALUES ('train', 0.7::DOUBLE, 0), ('test', 0.2::DOUBLE, 1), ('val', 0.1::DOUBLE, 2)),
c AS (SELECT split, want, place, count(cloud_id) AS n FROM w LEFT JOIN un USING (split) GROUP BY ALL), t AS (SELECT *, sum(n) OVER () AS total FROM c), o AS (SELECT *, max(abs(n / total - want)) OVER () AS off FROM t),
e AS (SELECT *, CASE WHEN off > 0.03 THEN n - round_even(want * total, 0)::BIGINT ELSE 0 END AS excess FROM o),
gt AS (SELECT *, sum(greatest(excess, 0)) OVER (ORDER BY place) AS gto, sum(greatest(-excess, 0)) OVER (ORDER BY place) AS tto FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {u('move', 'cloud_id')}, cloud_id) AS i FROM un),
m AS (SELECT cloud_id, k.split, CASE WHEN i <= excess THEN gto - excess + i END AS pos FROM k JOIN gt USING (split))
SELECT cloud_id, m.split, coalesce(gt.split, m.split) AS new_split FROM m LEFT JOIN gt ON gt.excess < 0 AND pos > tto + gt.excess AND pos <= tto""",
)

# Resampling and augmentation

_EXACT = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY {u('resample', 'cloud_id', 'point_id')}, point_id) AS i, count(*) OVER (PARTITION BY cloud_id) AS have FROM ev),
fw AS (SELECT cloud_id, any_value(have) AS have FROM rk GROUP BY 1 HAVING any_value(have) < {POINTS}), dr AS (SELECT *, unnest(generate_series(1, {POINTS} - have)) AS copy FROM fw)
SELECT cloud_id, point_id, x, y, z, 0 AS copy FROM rk WHERE i <= {POINTS} UNION ALL SELECT cloud_id, point_id, x, y, z, copy::INT FROM dr JOIN rk USING (cloud_id) WHERE i = floor({u('resample+', 'cloud_id', 'copy')} * dr.have) + 1"""
query("resample_exact", lambda s, d: sampling.exact(A.event_points(s, d), POINTS), f"WITH {EV}, {_EXACT}")


def _apart(v: str, w: str) -> str:
    return " + ".join(f"({v.format(a)} - {w.format(a)}) * ({v.format(a)} - {w.format(a)})" for a in AXES)


def _spread(source: str, key: str, n: int) -> str:
    """Farthest points of the groups of more than n rows."""
    return f"""al AS (SELECT *, count(*) OVER c AS have, {', '.join(f'avg({a}) OVER c AS m{a}' for a in AXES)} FROM ({source}) q WINDOW c AS (PARTITION BY {key})),
fp AS (SELECT 1 AS step, {key}, point_id, x, y, z, 'inf'::DOUBLE AS near, row_number() OVER (PARTITION BY {key} ORDER BY {_apart('{}', 'm{}')} DESC, point_id) = 1 AS taken FROM al WHERE have > {n}
  UNION ALL SELECT step + 1, {key}, point_id, x, y, z, near, row_number() OVER (PARTITION BY {key} ORDER BY near DESC, point_id) = 1
  FROM (SELECT p.* EXCLUDE (near, taken), least(p.near, {_apart('p.{}', 't.{}')}) AS near FROM fp p JOIN (SELECT {key}, x, y, z FROM fp WHERE taken) t USING ({key}) WHERE p.step < {n}) q)"""


query(
    "fps_sample",
    lambda s, d: sampling.farthest(A.event_points(s, d), POINTS),
    f"WITH RECURSIVE {_spread(A.EVENT_POINTS, 'cloud_id', POINTS)}, ev AS (SELECT cloud_id, point_id, x, y, z FROM al WHERE have <= {POINTS}), {_EXACT} UNION ALL SELECT cloud_id, point_id, x, y, z, 0 FROM fp WHERE taken",
)
query("fps_sample_across", lambda s, d: sampling.farthest(A.event_points(s, d), POINTS, 0), SQL["fps_sample"])
_KEY = "cloud_id, ix, iy"
query(
    "tile_samples",
    lambda s, d: voxels.tile_samples(A.event_points(s, d), TILE, OVERLAP, TILE_POINTS),
    f"""WITH RECURSIVE {_spread(f"SELECT t.*, x, y, z FROM ({SQL['overlap_tiles']}) t JOIN ({A.EVENT_POINTS}) e USING (cloud_id, point_id)", _KEY, TILE_POINTS)},
rk AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY point_id) AS i FROM al WHERE have >= {TILE_POINTS // 4} AND have < {TILE_POINTS}), dr AS (SELECT {_KEY}, have, unnest(generate_series(1, {TILE_POINTS})) AS copy FROM rk WHERE i = 1)
SELECT cloud_id, point_id, ix, iy, x, y, z, 0 AS copy, have < {TILE_POINTS // 4} AS noise FROM al WHERE have < {TILE_POINTS // 4} OR have = {TILE_POINTS} UNION ALL SELECT cloud_id, point_id, ix, iy, x, y, z, 0, false FROM fp WHERE taken
UNION ALL SELECT cloud_id, point_id, ix, iy, x, y, z, copy::INT, false FROM dr JOIN rk USING ({_KEY}) WHERE i = floor({u('tile', 'cloud_id', 'ix', 'iy', 'copy')} * dr.have) + 1""",
)
_WEIGHTS = "cw AS (SELECT label, count(*) AS n FROM sc GROUP BY 1), wt AS (SELECT label, n, pow(sum(n) OVER () / (count(*) OVER () * n), 0.45::DOUBLE) AS weight FROM cw)"
query("class_weights", lambda s, d: rounded(sampling.class_weights(A.scores(s, d)), 9), f"WITH {SC}, {_WEIGHTS} SELECT label, n, round(weight, 9) AS weight FROM wt")
query(
    "weighted_sample",
    lambda s, d: sampling.weighted(A.scores(s, d), A.scores(s, d).select(F.col("id").alias("draw"), rng.uniform("draw", "id").alias("u"))),
    f"""WITH {SC}, {_WEIGHTS}, ws AS (SELECT label, n, round(weight * 1000000)::BIGINT AS w FROM wt), wr AS (SELECT id, label, w, sum(w) OVER (ORDER BY label, id) AS upto, sum(w) OVER () AS total FROM sc JOIN ws USING (label)),
dd AS (SELECT id AS draw, floor({u('draw', 'id')} * (SELECT any_value(total) FROM wr)) AS pos FROM sc) SELECT draw, id, label FROM dd JOIN wr ON pos >= upto - w AND pos < upto""",
)
_P = "cloud_id, point_id"
query("gaussian_noise", lambda s, d: rounded(sampling.jitter(A.event_points(s, d)), 9), f"WITH {EV} SELECT {_P}, " + ", ".join(f"round({a} + 0.01::DOUBLE * {normal('j' + a, 'cloud_id', 'point_id')}, 9) AS {a}" for a in AXES) + " FROM ev")
_YAW = f"radians({b('yaw', 0, 360, 'cloud_id')})"
query("rotate_z", lambda s, d: rounded(sampling.yaw(A.event_points(s, d)), 9), f"WITH {EV}, a AS (SELECT *, {_YAW} AS t FROM ev) SELECT {_P}, round(x * cos(t) - y * sin(t), 9) + 0.0 AS x, round(x * sin(t) + y * cos(t), 9) + 0.0 AS y, z FROM a")
query("tilt_xy", lambda s, d: rounded(sampling.tilt(A.event_points(s, d)), 8), f"WITH {EV}, a AS (SELECT *, radians({b('tiltx', -10, 10, 'cloud_id')}) AS t, radians({b('tilty', -10, 10, 'cloud_id')}) AS v FROM ev), q AS (SELECT {_P}, v, x, y * cos(t) - z * sin(t) AS y, y * sin(t) + z * cos(t) AS z FROM a) SELECT {_P}, round(x * cos(v) + z * sin(v), 8) + 0.0 AS x, round(y, 8) + 0.0 AS y, round(z * cos(v) - x * sin(v), 8) + 0.0 AS z FROM q")
query("scale_xyz", lambda s, d: rounded(sampling.scale(A.event_points(s, d)), 9), f"WITH {EV} SELECT {_P}, " + ", ".join(f"round({a} * {b('s' + a, 0.9, 1.1, 'cloud_id')}, 9) AS {a}" for a in AXES) + " FROM ev")
query("aniso_scale", lambda s, d: rounded(sampling.scale_about_mean(A.event_points(s, d)), 6), f"WITH {EV}, {_BOX} SELECT {_P}, " + ", ".join(f"round(mean_{a} + ({a} - mean_{a}) * {b('m' + a, *sampling.RANGES[a], 'cloud_id')}, 6) AS {a}" for a in AXES) + " FROM ev JOIN bx USING (cloud_id)")
_R = "sqrt((ux - 0.5) * (ux - 0.5) + (uy - 0.5) * (uy - 0.5))"


def _c(v: str, low: float = 0, high: float = 1) -> str:
    return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {v}))"


def _keep(name: str, chance: Callable, seed: str, sql: str, survivors: int = 8) -> None:
    query(
        name,
        lambda s, d: sampling.keep(A.event_points(s, d), chance(), seed, survivors=survivors),
        f"""WITH {EV}, {_BOX}, un AS (SELECT {_P}, x, y, z, {_UNIT.format('u', 'u', 'u')} FROM ev JOIN bx USING (cloud_id)), ch AS (SELECT {_P}, x, y, z, {u(seed, 'cloud_id', 'point_id')} < ({sql}) AS stays FROM un),
lf AS (SELECT *, count_if(stays) OVER (PARTITION BY cloud_id) AS n FROM ch) SELECT {_P}, x, y, z FROM lf WHERE stays OR n < {survivors}""",
    )


_BUMP = f"((uz - {b('tc', 0.15, 0.85, 'cloud_id')}) / {b('tw', 0.10, 0.30, 'cloud_id')})"
_keep("aug_thinning", sampling.thinning, "k1", _c(f"{b('tb', 0.40, 0.88, 'cloud_id')} - 0.3::DOUBLE * {_c(f'({_R} - 0.25) / 0.45::DOUBLE')} - 0.2::DOUBLE * exp(-0.5::DOUBLE * {_BUMP} * {_BUMP})", 0.12, 1))
_S = f"(0.65::DOUBLE * {_c(f'({_R} - 0.15::DOUBLE) / 0.45::DOUBLE')} + 0.35::DOUBLE * {_c('(uz - 0.25) / 0.7::DOUBLE')})"
_keep("aug_branch_loss", sampling.branch_loss, "k2", f"0.9::DOUBLE * (1 - {_S}) + 0.45::DOUBLE * {_S}")


def _cuboids() -> str:
    out = []
    for k in range(8):
        near = " AND ".join(f"abs(u{a} - {u(f'cc{k}{a}', 'cloud_id')}) <= {b(f'cs{k}{a}', low, high, 'cloud_id')} / 2" for a, (low, high) in {"x": (0.07, 0.20), "y": (0.07, 0.20), "z": (0.07, 0.25)}.items())
        out.append(f"CASE WHEN {k} < 2 + floor({u('cn', 'cloud_id')} * 7) AND {near} THEN 1 - {b(f'cd{k}', 0.45, 0.80, 'cloud_id')} ELSE 1 END")
    return " * ".join(f"({x})" for x in out)


_keep("aug_cuboid", sampling.cuboids, "k3", _cuboids())
_keep("aug_band", sampling.bands, "k4", " * ".join(f"(CASE WHEN abs(uz - {b(f'bc{k}', 0.05, 0.95, 'cloud_id')}) < {b(f'bh{k}', 0.06, 0.20, 'cloud_id')} / 2" + (f" AND {u('bn', 'cloud_id')} < 0.5" if k else "") + f" THEN 1 - {b(f'bd{k}', 0.35, 0.75, 'cloud_id')} ELSE 1 END)" for k in range(2)))
_keep("aug_vcrop", sampling.vertical_crop, "k5", f"CASE WHEN uz >= (CASE WHEN {u('vb', 'cloud_id')} < 0.6::DOUBLE THEN {b('vl', 0, 0.12, 'cloud_id')} ELSE 0 END) AND uz <= 1 - (CASE WHEN {u('vt', 'cloud_id')} < 0.5 THEN {b('vh', 0, 0.12, 'cloud_id')} ELSE 0 END) THEN 1.0 ELSE 0.0 END")
_keep("aug_bcrop", sampling.bottom_crop, "k6", f"CASE WHEN uz >= {b('bb', 0.12, 0.45, 'cloud_id')} THEN 1.0 ELSE 0.0 END")


def _added(kind: str, low: float, high: float, least: int) -> str:
    ends = f"(SELECT *, greatest({least}, floor({low}::DOUBLE * n)) AS low, greatest({least + 1}, floor({high}::DOUBLE * n)) AS high FROM bx)"
    return f"ad AS (SELECT *, (low + floor({u(kind + 'n', 'cloud_id')} * (high - low + 1)))::INT AS total FROM {ends} q), dr AS (SELECT *, unnest(generate_series(1, total)) AS k FROM ad)"


def _side(seed: str) -> str:
    return f"(CASE WHEN {u(seed, 'cloud_id')} < 0.5 THEN -1 ELSE 1 END)"


query(
    "aug_crown_leak",
    lambda s, d: rounded(sampling.crown_leak(A.event_points(s, d))),
    f"""WITH {EV}, {_BOX}, {_added('cl', 0.03, 0.24, 32)},
cr AS (SELECT ev.*, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) AS i, count(*) OVER (PARTITION BY cloud_id) AS c FROM ev JOIN bx USING (cloud_id) WHERE (z - min_z) / greatest(max_z - min_z, 1e-6::DOUBLE) > {b('cl', 0.45, 0.70, 'cloud_id')}),
st AS (SELECT dr.*, floor({u('cld', 'cloud_id', 'k')} * c) + 1 AS i FROM dr JOIN (SELECT DISTINCT cloud_id, c FROM cr WHERE c >= 32) q USING (cloud_id) WHERE {u('clk', 'cloud_id', 'k')} < {b('clp', 0.20, 0.55, 'cloud_id')})
SELECT cloud_id, point_id, k::INT AS k, round(x + {_side('cls')} * {b('clx', 0.2, 0.6, 'cloud_id')} * (max_x - min_x), 6) + 0.0 AS x, round(y + {b('cly', -0.3, 0.3, 'cloud_id')} * (max_y - min_y), 6) + 0.0 AS y,
  round(z + {b('clz', -0.06, 0.06, 'cloud_id')} * (max_z - min_z), 6) + 0.0 AS z FROM st JOIN cr USING (cloud_id, i)""",
)
query(
    "aug_stem",
    lambda s, d: rounded(sampling.stem(A.event_points(s, d))),
    f"""WITH {EV}, {_BOX}, {_added('st', 0.02, 0.16, 32)}
SELECT cloud_id, k::INT AS k, round(mean_x + {_side('sts')} * {b('stx', 0.30, 0.65, 'cloud_id')} * (max_x - min_x) + 0.012::DOUBLE * (max_x - min_x) * {normal('stnx', 'cloud_id', 'k')}, 6) + 0.0 AS x,
  round(mean_y + {b('sty', -0.30, 0.30, 'cloud_id')} * (max_y - min_y) + 0.012::DOUBLE * (max_y - min_y) * {normal('stny', 'cloud_id', 'k')}, 6) + 0.0 AS y, round(min_z + {u('stz', 'cloud_id', 'k')} * (max_z - min_z), 6) + 0.0 AS z FROM dr""",
)
_STRAY = ", ".join(
    f"round((min_{a} + max_{a}) / 2 + {b('ou' + a, *at, 'cloud_id', 'c')} * (max_{a} - min_{a}) + {b('os' + a, 0.01, most, 'cloud_id', 'c')} * (max_{a} - min_{a}) * {normal('on' + a, 'cloud_id', 'k')}, 6) + 0.0 AS {a}" for a, (at, most) in sampling.OUTLIERS.items()
)
query(
    "aug_outliers",
    lambda s, d: rounded(sampling.outliers(A.event_points(s, d))),
    f"""WITH {EV}, {_BOX}, {_added('ou', 0.01, 0.09, 16)}, cn AS (SELECT *, (1 + floor({u('ouc', 'cloud_id')} * 3))::INT AS clusters FROM ad), ea AS (SELECT *, greatest(4, total // clusters) AS size FROM cn),
ks AS (SELECT *, unnest(generate_series(1, clusters * size)) AS k FROM ea), cs AS (SELECT *, ((k - 1) // size)::INT AS c FROM ks) SELECT cloud_id, k::INT AS k, {_STRAY} FROM cs""",
)
query("aug_tree_copy", lambda s, d: rounded(sampling.tree_copy(A.event_points(s, d))))
query("domain_augment", lambda s, d: rounded(sampling.augment(A.event_points(s, d), POINTS)))

# Species refinement

MAP_TILE, SHAPE_TILE = 25.0, 5.0
_PAIRS = ", ".join(f"('{seg}', '{code}')" for seg, code in T.CODES.items())
_INV = ", ".join(f"('{c}', {i}, {T.genus_of(latin)})" for i, (c, latin) in enumerate(T.INVENTORY))
_DEF = ", ".join(f"({i}, {T.default_species(g)})" for i, g in enumerate(T.GENERA))


def _stands(s: SparkSession, d: str) -> DataFrame:
    return A.stands(s, d).select("stand_id", "x", (F.pmod("y", F.lit(100.0))).alias("y"), spatial.lookup(T.CODES, F.col("code")).alias("species_code"))


def _map(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    grid = spatial.tile_grid(_stands(s, d), MAP_TILE)
    return grid, spatial.tile_species(_stands(s, d), grid, MAP_TILE)


def _placed(s: SparkSession, d: str) -> DataFrame:
    middle = A.event_points(s, d).groupBy("cloud_id").agg((F.round(F.avg("x"), 6) % 100).alias("x"), (F.round(F.avg("y"), 6) % 100).alias("y"))
    return spatial.tile_of(middle.withColumn("genus", (F.col("cloud_id") % 17).cast("int")), _map(s, d)[0], MAP_TILE)


_TILE = ", ".join(f"least(trunc(({a} - o{a}) / {MAP_TILE}::DOUBLE)::INT, n{a} - 1) AS i{a}" for a in "xy")
_MAP = f"""WITH {EV}, pr(seg, code) AS (VALUES {_PAIRS}), iv(code, species, genus) AS (VALUES {_INV}), df(genus, first) AS (VALUES {_DEF}),
sd AS (SELECT stand_id, x, ((y % 100) + 100) % 100 AS y, pr.code AS code FROM ({A.STANDS}) q JOIN pr ON pr.seg = q.code),
g0 AS (SELECT min(x) AS lox, max(x) AS hix, min(y) AS loy, max(y) AS hiy FROM sd), g1 AS (SELECT *, greatest(1, ceil((hix - lox) / {MAP_TILE}::DOUBLE)::INT) AS nx, greatest(1, ceil((hiy - loy) / {MAP_TILE}::DOUBLE)::INT) AS ny FROM g0),
gr AS (SELECT nx, ny, (lox + hix) / 2 - nx * {MAP_TILE}::DOUBLE / 2 AS ox, (loy + hiy) / 2 - ny * {MAP_TILE}::DOUBLE / 2 AS oy FROM g1),
tm AS (SELECT ix, iy, species, genus, count(*) AS n, min(stand_id) AS first_seen FROM (SELECT stand_id, code, {_TILE} FROM sd, gr) q JOIN iv USING (code) WHERE ix >= 0 AND iy >= 0 GROUP BY ALL),
ce AS (SELECT cloud_id, (cloud_id % 17)::INT AS genus, round(avg(x), 6) % 100 AS x, round(avg(y), 6) % 100 AS y FROM ev GROUP BY cloud_id),
pl AS (SELECT * FROM (SELECT cloud_id, genus, x, y, {_TILE} FROM ce, gr) q WHERE ix >= 0 AND iy >= 0),
tp AS (SELECT ix, iy, arg_max(species, (n, -first_seen)) AS top FROM tm GROUP BY ALL), ow AS (SELECT ix, iy, genus, arg_max(species, (n, -first_seen)) AS own FROM tm GROUP BY ALL),
jn AS (SELECT pl.*, top, own, df.first FROM pl LEFT JOIN tp USING (ix, iy) LEFT JOIN ow USING (ix, iy, genus) JOIN df USING (genus))"""


def _resolved(otherwise: str, top: str) -> str:
    return f"{_MAP} SELECT cloud_id, genus, ix, iy, CASE WHEN genus = 15 THEN 24 WHEN genus = 16 THEN coalesce({top}, 23) ELSE coalesce(own, {otherwise}) END AS species FROM jn"


def _refine(model_based: bool, birch: bool) -> Query:
    return lambda s, d: spatial.resolve(_placed(s, d), _map(s, d)[1], model_based, birch).select("cloud_id", "genus", "ix", "iy", "species")


query("tile_map", lambda s, d: _map(s, d)[1], f"{_MAP} SELECT ix, iy, species, n, first_seen FROM tm")
query("tile_lookup", lambda s, d: _placed(s, d).select("cloud_id", "ix", "iy"), f"{_MAP} SELECT cloud_id, ix, iy FROM pl")
query("resolve_species", _refine(False, True), _resolved("nullif(top, 0), first", "nullif(top, 0)"))
query("resolve_species_intended", _refine(False, False), _resolved("top, first", "top"))
query("resolve_model_based", _refine(True, True), _resolved("first", "nullif(top, 0)"))
query("refine_predictions", lambda s, d: _refine(False, True)(s, d).select("cloud_id", "species", spatial.genus_of_species(F.col("species")).alias("refined_genus")), f"SELECT cloud_id, q.species, iv.genus AS refined_genus FROM ({_resolved('nullif(top, 0), first', 'nullif(top, 0)')}) q JOIN (SELECT * FROM (VALUES {_INV}) t(code, species, genus)) iv USING (species)")
query(
    "features_json",
    lambda s, d: spatial.features(
        A.table(s, d, "events").select("event_id", F.concat(F.lit('{"features":[{"properties":{"species_cd":"'), F.get_json_object("props", "$.k"), F.lit('","region_name":"'), "event_type", F.lit('"}},{"properties":{"species_cd":"SO"}}],"links":[{"rel":"self","href":"a"},{"rel":"next","href":"p'), F.col("event_id") + 1, F.lit('"}]}')).alias("page")), "page"
    ),
    """WITH pg AS (SELECT event_id, '{"features":[{"properties":{"species_cd":"' || json_extract_string(props, '$.k') || '","region_name":"' || event_type || '"}},{"properties":{"species_cd":"SO"}}],"links":[{"rel":"self","href":"a"},{"rel":"next","href":"p' || (event_id + 1) || '"}]}' AS page FROM events),
ft AS (SELECT event_id, json_extract_string(page, '$.links[1].href') AS next, unnest(json_extract(page, '$.features[*]')) AS f FROM pg) SELECT event_id, next, json_extract_string(f, '$.properties.species_cd') AS species_cd, json_extract_string(f, '$.properties.region_name') AS region_name FROM ft""",
)

#: Size of the box about a spot, and of the cells of region boxes.
SPOT, REGION_CELL, SPOT_METRES, CRS = 10.0, 10.0, 8000.0, "EPSG:2180"
_NAMES = [*T.REGIONS, "NOWHERE"]


def _spots(s: SparkSession, d: str) -> DataFrame:
    middle = A.event_points(s, d).groupBy("cloud_id").agg((F.round(F.avg("x"), 6) % 100).alias("x"), (F.round(F.avg("y"), 6) % 100).alias("y"))
    return middle.select(F.col("cloud_id").alias("spot_id"), "x", "y", (F.col("cloud_id") % 17).cast("int").alias("genus"))


def _boxes(s: SparkSession, d: str) -> DataFrame:
    """Overlapping boxes of regions, one of which the table of regions lacks."""
    k = F.col("n_nationkey")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (k % len(_NAMES) + 1).cast("int"))
    box = [(k * 4 % 100).cast("double").alias("lox"), (k * 4 % 100 + 30).cast("double").alias("hix"), (k * 7 % 100).cast("double").alias("loy"), (k * 7 % 100 + 40).cast("double").alias("hiy")]
    return A.table(s, d, "nation").select(k.alias("box_id"), name.alias("region"), *box)


_SPOTS = "ce AS (SELECT cloud_id AS spot_id, (cloud_id % 17)::INT AS genus, round(avg(x), 6) % 100 AS x, round(avg(y), 6) % 100 AS y FROM ev GROUP BY cloud_id)"
_REGIONS = ", ".join(f"('{k}', '{v}')" for k, v in T.REGIONS.items())
query(
    "region_lookup",
    lambda s, d: spatial.regions_of(_spots(s, d), _boxes(s, d), REGION_CELL),
    f"""WITH {EV}, {_SPOTS}, rg(region, collection) AS (VALUES {_REGIONS}),
bo AS (SELECT n_nationkey AS box_id, {_NAMES!r}[n_nationkey % {len(_NAMES)} + 1] AS region, n_nationkey * 4 % 100 AS lox, n_nationkey * 7 % 100 AS loy FROM nation),
ht AS (SELECT spot_id, arg_min(region, box_id) AS region FROM ce JOIN bo ON x BETWEEN lox AND lox + 30 AND y BETWEEN loy AND loy + 40 GROUP BY 1)
SELECT spot_id, region, collection FROM ce LEFT JOIN ht USING (spot_id) LEFT JOIN rg USING (region)""",
)
_NEAR = f"""{_MAP},
nr AS (SELECT cloud_id, species, iv.genus, count(*) AS n, min(stand_id) AS first_seen FROM ce JOIN sd ON abs(sd.x - ce.x) <= {SPOT / 2} AND abs(sd.y - ce.y) <= {SPOT / 2} JOIN iv USING (code) GROUP BY ALL),
nt AS (SELECT cloud_id, arg_max(species, (n, -first_seen)) AS top FROM nr GROUP BY 1), no AS (SELECT cloud_id, genus, arg_max(species, (n, -first_seen)) AS own FROM nr GROUP BY ALL)"""
query(
    "find_species",
    lambda s, d: spatial.find_species(_spots(s, d), _stands(s, d), SPOT),
    f"""{_NEAR} SELECT cloud_id AS spot_id, genus, CASE WHEN genus = 15 THEN 24 WHEN genus = 16 THEN coalesce(nullif(top, 0), 23) ELSE coalesce(own, nullif(top, 0), first) END AS species
FROM ce LEFT JOIN nt USING (cloud_id) LEFT JOIN no USING (cloud_id, genus) JOIN df USING (genus)""",
)


#: Shapes about each stand: a star of seven corners with a hole, and a triangle beside it. (ring, corners, radius, turn, shift)
_RINGS = [("s", 7, 9.0, 0.0, 0.0), ("h", 5, 2.0, 0.7, 0.0), ("t", 3, 4.0, 0.3, 17.0)]


def _shapes(s: SparkSession, d: str) -> DataFrame:
    def ring(name: str, corners: int, radius: float, turn: float, shift: float) -> Column:
        def corner(j: Column) -> Column:
            r, angle = radius * (0.6 + 0.8 * rng.uniform(name, "stand_id", j)), turn + j * (2 * math.pi / corners)
            return F.struct(F.round(F.col("x") + shift + r * F.cos(angle), 6).alias("x"), F.round(F.col("y") + r * F.sin(angle), 6).alias("y"))

        return F.array(*(corner(F.lit(j)) for j in range(corners)))

    return _stands(s, d).select("stand_id", "species_code", F.array(*(ring(*k) for k in _RINGS)).alias("rings"))


def _shape_grid(s: SparkSession, d: str) -> DataFrame:
    return spatial.tile_grid(_stands(s, d).where("species_code is not null"), SHAPE_TILE)


def _corner(name: str, corners: int, radius: float, turn: float, shift: float, j: str) -> str:
    r, angle = f"{radius}::DOUBLE * (0.6::DOUBLE + 0.8::DOUBLE * {u(name, 'stand_id', j)})", f"({turn}::DOUBLE + {j} * {2 * math.pi / corners!r}::DOUBLE)"
    return f"round(x + {shift}::DOUBLE + {r} * cos{angle}, 6) AS px, round(y + {r} * sin{angle}, 6) AS py"


_CORNERS = " UNION ALL ".join(f"SELECT stand_id, code, '{k[0]}' AS ring, {k[1]} AS k, j, {_corner(*k, 'j')} FROM sd, range({k[1]}) AS _(j)" for k in _RINGS)
#: All pairs of edges and tiles: a segment and a box meet unless an axis or the segment's normal parts them; and the middle of each tile against all edges of a shape.
_POLYGONS = f"""{_MAP.replace(f"{MAP_TILE}::DOUBLE", f"{SHAPE_TILE}::DOUBLE")}, co AS ({_CORNERS}),
eg AS (SELECT a.stand_id, a.code, (a.px - ox) / {SHAPE_TILE}::DOUBLE AS u1, (a.py - oy) / {SHAPE_TILE}::DOUBLE AS v1, (b.px - ox) / {SHAPE_TILE}::DOUBLE AS u2, (b.py - oy) / {SHAPE_TILE}::DOUBLE AS v2 FROM co a JOIN co b ON b.stand_id = a.stand_id AND b.ring = a.ring AND b.j = (a.j + 1) % a.k, gr),
tl AS (SELECT ix, iy, ix + 0.5::DOUBLE AS mu, iy + 0.5::DOUBLE AS mv FROM gr, LATERAL (SELECT unnest(range(nx))::INT AS ix), LATERAL (SELECT unnest(range(ny))::INT AS iy)),
pt AS (SELECT stand_id, code, ix, iy FROM eg, tl GROUP BY ALL HAVING bool_or(greatest(u1, u2) >= ix AND least(u1, u2) <= ix + 1 AND greatest(v1, v2) >= iy AND least(v1, v2) <= iy + 1 AND abs((u2 - u1) * (v1 - mv) - (v2 - v1) * (u1 - mu)) <= (abs(u2 - u1) + abs(v2 - v1)) / 2)
  OR count(*) FILTER ((v1 <= mv) <> (v2 <= mv) AND u1 + (mv - v1) / nullif(v2 - v1, 0) * (u2 - u1) > mu) % 2 = 1)"""
query("polygon_tiles", lambda s, d: spatial.polygon_tiles(_shapes(s, d), _shape_grid(s, d), SHAPE_TILE), f"{_POLYGONS} SELECT stand_id, ix, iy FROM pt")
query("polygon_species", lambda s, d: spatial.polygon_species(_shapes(s, d), _shape_grid(s, d), SHAPE_TILE), f"{_POLYGONS} SELECT ix, iy, species, count(*) AS n, min(stand_id) AS first_seen FROM pt JOIN iv USING (code) GROUP BY ALL")


def _degrees(rows: DataFrame) -> DataFrame:
    """Places of 0 to 100 as degrees about the middle of Poland."""
    return rows.withColumns({"lat": 51.5 + F.col("y") / 100, "lon": 18.5 + F.col("x") / 100})


def _boxes_of_degrees(s: SparkSession, d: str) -> DataFrame:
    """Each stand's square in degrees, which has to hold all points of its edges: the number of those that it doesn't hold, by stand; corners alone would leave some out."""
    boxed = geodesy.with_box(geodesy.with_grid(_degrees(_stands(s, d)), CRS).select("stand_id", "x", "y"), SPOT_METRES * 5, CRS)
    along = boxed.withColumn("t", F.explode(F.sequence(F.lit(-20), F.lit(20)))).withColumn("side", F.explode(F.array(*map(F.lit, range(4)))))
    step, half = F.col("t") / 20 * SPOT_METRES * 5, F.lit(SPOT_METRES * 5)
    x = F.col("x") + F.when(F.col("side") < 2, step).when(F.col("side") == 2, half).otherwise(-half)
    y = F.col("y") + F.when(F.col("side") >= 2, step).when(F.col("side") == 0, half).otherwise(-half)
    lat, lon = geodesy.unproject(x, y, geodesy.system(CRS))
    out = (lat < F.col("south") - 1e-12) | (lat > F.col("north") + 1e-12) | (lon < F.col("west") - 1e-12) | (lon > F.col("east") + 1e-12)
    return along.groupBy("stand_id").agg(F.sum(F.when(out, 1).otherwise(0)).alias("outside"), F.count("*").alias("points"))


def _collected(s: SparkSession, d: str) -> DataFrame:
    """Stands with a collection each, by their number; one in ten has none."""
    names = list(T.REGIONS.values())
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("stand_id") % len(names) + 1).cast("int"))
    return _stands(s, d).withColumn("collection", F.when(F.col("stand_id") % 10 != 3, name))


query(
    "find_species_by_region",
    lambda s, d: spatial.find_species_by_region(_spots(s, d), _collected(s, d), _boxes(s, d), SPOT * 4, REGION_CELL),
    f"""{_NEAR.replace("nr AS", f"rl AS ({SQL['region_lookup']}), nr AS", 1).replace("FROM ce JOIN sd ON", f"FROM ce JOIN rl ON rl.spot_id = ce.cloud_id JOIN sd ON sd.stand_id % 10 <> 3 AND rl.collection = {list(T.REGIONS.values())!r}[sd.stand_id % {len(T.REGIONS)} + 1] AND").replace(str(SPOT / 2), str(SPOT * 2))} SELECT cloud_id AS spot_id, genus, CASE WHEN genus = 15 THEN 24 WHEN genus = 16 THEN coalesce(nullif(top, 0), 23) ELSE coalesce(own, nullif(top, 0), first) END AS species
FROM ce LEFT JOIN nt USING (cloud_id) LEFT JOIN no USING (cloud_id, genus) JOIN df USING (genus)""",
)
_TM = geodesy.sql_of("lat", "lon", CRS)
_LATLON = "51.5::DOUBLE + y / 100 AS lat, 18.5::DOUBLE + x / 100 AS lon"
query("grid_coordinates", lambda s, d: rounded(geodesy.with_grid(_degrees(_stands(s, d)), CRS).select("stand_id", "x", "y"), 3), f"{_MAP} SELECT stand_id, round({_TM[0]}, 3) + 0.0 AS x, round({_TM[1]}, 3) + 0.0 AS y FROM (SELECT stand_id, {_LATLON} FROM sd)")
query("grid_round_trip", lambda s, d: rounded(geodesy.with_degrees(geodesy.with_grid(_degrees(_stands(s, d)), CRS).drop("lat", "lon"), CRS).select("stand_id", "lat", "lon"), 9), f"{_MAP} SELECT stand_id, {r('lat', 'lon', digits=9)} FROM (SELECT stand_id, {_LATLON} FROM sd)")
query("grid_boxes", _boxes_of_degrees, f"{_MAP} SELECT stand_id, 0 AS outside, 164 AS points FROM sd")
query(
    "find_species_at",
    lambda s, d: geodesy.find_species_at(_degrees(_spots(s, d)), _degrees(_stands(s, d)), SPOT_METRES, CRS),
    f"""{_NEAR.replace("nr AS", f"sg AS (SELECT stand_id, code, {_TM[0]} AS x, {_TM[1]} AS y FROM (SELECT stand_id, code, {_LATLON} FROM sd)), cg AS (SELECT cloud_id, {_TM[0]} AS x, {_TM[1]} AS y FROM (SELECT cloud_id, {_LATLON} FROM ce)), nr AS", 1).replace("FROM ce JOIN sd ON", "FROM cg ce JOIN sg sd ON").replace(str(SPOT / 2), f"{SPOT_METRES / 2}")} SELECT cloud_id AS spot_id, genus, CASE WHEN genus = 15 THEN 24 WHEN genus = 16 THEN coalesce(nullif(top, 0), 23) ELSE coalesce(own, nullif(top, 0), first) END AS species
FROM ce LEFT JOIN nt USING (cloud_id) LEFT JOIN no USING (cloud_id, genus) JOIN df USING (genus)""",
)
_EDGE = " ".join(f"CROSS JOIN LATERAL (SELECT unnest(list_distinct([floor(({a} - o{a}) / {MAP_TILE}::DOUBLE)::INT, (ceil(({a} - o{a}) / {MAP_TILE}::DOUBLE) - 1)::INT])) AS i{a}) t{a}" for a in "xy")
query(
    "feature_tiles",
    lambda s, d: spatial.feature_tiles(_stands(s, d), spatial.tile_grid(_stands(s, d).where("species_code is not null"), MAP_TILE), MAP_TILE),
    f"{_MAP} SELECT stand_id, ix, iy FROM sd CROSS JOIN gr {_EDGE} WHERE ix >= 0 AND ix < nx AND iy >= 0 AND iy < ny",
)


def _predicted(s: SparkSession, d: str) -> DataFrame:
    label = labels.coerced(F.array((F.col("cloud_id") % 17).cast("int")))
    known = A.event_points(s, d).select("cloud_id").distinct().withColumn("has_points", F.lit(True))
    every = A.clouds(s, d).select("cloud_id", label.alias("genus")).join(known, "cloud_id", "left").na.fill(False, ["has_points"])
    return spatial.resolve_all(every, _placed(s, d), _map(s, d)[1]).select("cloud_id", "genus", "species")


query(
    "predict_species",
    _predicted,
    f"""{_MAP}, al AS (SELECT p_partkey AS cloud_id, (p_partkey % 17)::INT AS genus FROM part)
SELECT cloud_id, al.genus, CASE WHEN ce.cloud_id IS NULL OR al.genus = 15 THEN 24 WHEN al.genus = 16 THEN coalesce(nullif(top, 0), 23) ELSE coalesce(own, nullif(top, 0), first) END AS species
FROM al LEFT JOIN ce USING (cloud_id) LEFT JOIN (SELECT cloud_id, ix, iy FROM pl) pp USING (cloud_id) LEFT JOIN tp USING (ix, iy) LEFT JOIN (SELECT ix, iy, genus, own FROM ow) oo ON oo.ix = pp.ix AND oo.iy = pp.iy AND oo.genus = al.genus JOIN df ON df.genus = al.genus""",
)

# The training sample

IGNORE = 15


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return A.event_points(s, d).withColumn("label", (F.col("cloud_id") % 17).cast("int"))


_FINITE = "isfinite(x) AND isfinite(y) AND isfinite(z)"
_SAFE = f"{EV}, li AS (SELECT cloud_id, x, y, z FROM ev WHERE {_FINITE} AND cloud_id % 17 < {IGNORE} AND cloud_id IN (SELECT cloud_id FROM ev WHERE {_FINITE} GROUP BY 1 HAVING count(*) >= 16))"
query("dataset_sample", lambda s, d: rounded(dataset.dataset(_labelled(s, d), SIZE, IGNORE)), f"{_views_sql('li').replace(LI, _SAFE)} SELECT cloud_id, (cloud_id % 17)::INT AS label, view, \"row\", col, {r('value')} FROM vw")
query("dataset_training", lambda s, d: rounded(dataset.dataset(_labelled(s, d), SIZE, IGNORE, training=True, n=POINTS)))


def _plot_points(s: SparkSession, d: str) -> DataFrame:
    return A.event_points(s, d).select(F.concat(F.lit("plot"), F.col("cloud_id") % 5).alias("source"), (F.col("cloud_id") % 60).alias("tree_id"), "point_id", (F.col("z") % 4).cast("int").alias("species"), (F.col("point_id") % 2).cast("int").alias("inside"), *AXES)


query(
    "plot_trees",
    lambda s, d: clean.plot_trees(_plot_points(s, d), 95.0),
    f"""WITH {EV}, pp AS (SELECT 'plot' || (cloud_id % 5) AS source, cloud_id % 60 AS tree_id, point_id, (z % 4)::INT AS species, (point_id % 2)::INT AS inside, z FROM ev WHERE cloud_id % 60 <> 0),
tr AS (SELECT source, tree_id, arg_min(inside, point_id) AS inside, arg_min(species, point_id) AS species, count(*) AS n, max(z) - min(z) AS height FROM pp GROUP BY ALL)
SELECT *, concat_ws('_', source, tree_id, inside, species) || '.npy' AS path FROM tr WHERE species <> 0 AND height >= 95""",
)
query("suffix_filter", lambda s, d: labels.of_label(labels.required(A.clouds(s, d), ["cloud_id", "path"]), 15), f"WITH {CL} SELECT * FROM cl WHERE ends_with(path, '_15.npy')")
query(
    "split_fallback",
    lambda s, d: labels.split_safe(labels.parsed(A.clouds(s, d)).select("cloud_id", "label"), "label", "fallback"),
    f"""WITH {CL}, {_PARSED}, fm AS (SELECT cloud_id, label, CASE WHEN (SELECT min(n) >= 2 FROM (SELECT count(*) AS n FROM pa GROUP BY label) g) THEN label::VARCHAR ELSE 'all' END AS family FROM pa),
so AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {u('fallback', 'cloud_id')}, cloud_id) AS p, count(*) OVER (PARTITION BY family) AS n FROM fm), sb AS (SELECT *, floor(n * 0.7::DOUBLE + 0.5) AS qa FROM so), sq AS (SELECT *, qa + floor((n - qa) * (2::DOUBLE / 3) + 0.5) AS qb FROM sb)
SELECT cloud_id, label, CASE WHEN p <= qa THEN 'train' WHEN p <= qb THEN 'test' ELSE 'val' END AS split FROM sq""",
)

# Evaluation

_PRED = "pd AS (SELECT id, label, (list_position(logits, list_max(logits)) - 1)::INT AS pred, logits FROM sc)"
_SOFT = "sx AS (SELECT id, label, list_transform(logits, lambda v: exp(v - list_max(logits))) AS e FROM sc), sm AS (SELECT id, label, list_transform(e, lambda v: v / list_sum(e)) AS p FROM sx)"
query("predict_argmax", lambda s, d: evaluate.predicted(A.scores(s, d)).select("id", "label", "pred"), f"WITH {SC}, {_PRED} SELECT id, label, pred FROM pd")
query("softmax_probs", lambda s, d: rounded(A.scores(s, d).select("id", F.posexplode(evaluate.softmax()).alias("class", "p")), 9), f"WITH {SC}, {_SOFT}, x AS (SELECT id, unnest(range(10)) AS class, unnest(p) AS p FROM sm) SELECT id, class::INT AS class, round(p, 9) AS p FROM x")
query("confusion_matrix", lambda s, d: evaluate.confusion(evaluate.predicted(A.scores(s, d))), f"WITH {SC}, {_PRED} SELECT label, pred, count(*) AS n FROM pd GROUP BY ALL")
query("accuracy", lambda s, d: rounded(evaluate.accuracy(evaluate.predicted(A.scores(s, d)), 7), 9), f"WITH {SC}, {_PRED} SELECT round(coalesce(avg((pred = label)::INT), 0), 9) AS accuracy, count(*) AS n FROM pd WHERE label < 7")
query("masked_loss_mean", lambda s, d: rounded(evaluate.masked_mean(A.scores(s, d).select("label", (F.element_at("logits", 1) + 1).alias("loss"), (F.col("id") % 5 + 1).alias("n")), "loss", "n", "label", 7)), f"WITH {SC} SELECT round(coalesce(sum((logits[1] + 1) * (id % 5 + 1)) / sum(id % 5 + 1), 0), 6) AS mean FROM sc WHERE label < 7")
_CURVE = f"WITH {SC}, x AS (SELECT label, unnest(range(10))::INT AS class, round(unnest(logits), 3) AS threshold FROM sc), y AS (SELECT class, threshold, count_if(label = class) AS p, count_if(label <> class) AS q FROM x GROUP BY ALL), z AS (SELECT class, threshold, sum(p) OVER d AS tp, sum(q) OVER d AS fp, sum(p) OVER w AS positives, sum(q) OVER w AS negatives FROM y WINDOW d AS (PARTITION BY class ORDER BY threshold DESC), w AS (PARTITION BY class))"
query("roc_points", lambda s, d: rounded(evaluate.roc(A.scores(s, d), CLASSES), 9), f"{_CURVE} SELECT class, round(threshold, 9) + 0.0 AS threshold, round(tp / nullif(positives, 0), 9) AS tpr, round(fp / nullif(negatives, 0), 9) AS fpr FROM z")
query("prc_points", lambda s, d: rounded(evaluate.prc(A.scores(s, d), CLASSES), 9), f"{_CURVE} SELECT class, round(threshold, 9) + 0.0 AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / nullif(positives, 0), 9) AS recall FROM z")
query("threshold_hist", lambda s, d: evaluate.histogram(A.scores(s, d)), f"WITH {SC}, {_SOFT} SELECT least(19, floor(round(list_max(p), 9) * 20))::INT AS bin, count(*) AS n FROM sm GROUP BY ALL")
query(
    "class_report",
    lambda s, d: rounded(evaluate.report(evaluate.predicted(A.scores(s, d))), 9),
    f"""WITH {SC}, {_PRED}, l AS (SELECT label AS class, count(*) AS support, count_if(label = pred) AS hit FROM pd GROUP BY 1), s AS (SELECT pred AS class, count(*) AS said FROM pd GROUP BY 1), t AS (SELECT class, coalesce(support, 0)::BIGINT AS support, coalesce(hit / said, 0) AS p, coalesce(hit / support, 0) AS r FROM l FULL JOIN s USING (class))
SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1, support FROM t""",
)


def _history(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = A.table(s, d, "events")
    return e.select(F.col("user_id").alias("trial"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("step"), (F.col("value") / 500).alias("acc"), (F.get_json_object("props", "$.k").cast("double") / 10).alias("loss"))


_HIST = "hs AS (SELECT user_id AS trial, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS step, value / 500 AS acc, json_extract_string(props, '$.k')::DOUBLE / 10 AS loss FROM events)"
query("running_best", lambda s, d: rounded(evaluate.running_best(_history(s, d), "trial", "step", "acc"), 9), f"WITH {_HIST}, rb AS (SELECT *, coalesce(max(acc) OVER (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best FROM hs) SELECT trial, step, {r('acc', 'loss', 'best', digits=9)}, acc > best AS is_best FROM rb")
query("trial_objective", lambda s, d: rounded(evaluate.objective(_history(s, d), "trial", "acc", "loss"), 9), f"WITH {_HIST} SELECT trial, round(0.6::DOUBLE * max(acc) + 0.4::DOUBLE / (1 + min(loss)), 9) AS objective FROM hs GROUP BY 1")
_OBJECTIVE = f"WITH {_HIST}, ob AS (SELECT trial, 0.6::DOUBLE * max(acc) + 0.4::DOUBLE / (1 + min(loss)) AS objective FROM hs GROUP BY 1)"
query("best_trial", lambda s, d: rounded(evaluate.best_trial(evaluate.objective(_history(s, d), "trial", "acc", "loss"), "trial"), 9, "objective"), f"{_OBJECTIVE} SELECT trial, round(objective, 9) AS objective FROM ob ORDER BY objective DESC, trial LIMIT 1")
query("case_score", lambda s, d: rounded(evaluate.case_score(_history(s, d), "trial", "step", "acc", "loss"), 9), f"WITH {_HIST} SELECT trial, round(0.6::DOUBLE * arg_max(acc, step) + 0.4::DOUBLE / (1 + arg_max(loss, step)), 9) AS score FROM hs GROUP BY 1")
query("prune_median", lambda s, d: evaluate.pruned(_history(s, d), "trial", "step", "acc", 30, 25), f"WITH {_HIST}, md AS (SELECT *, quantile_cont(acc, 0.5) OVER e AS m, count(*) OVER e AS n FROM hs WINDOW e AS (PARTITION BY step ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT trial, step FROM md WHERE n >= 30 AND step >= 25 AND acc < m")
query("prune_median_interval", lambda s, d: evaluate.pruned(_history(s, d), "trial", "step", "acc", 30, 25, 5, 16), f"SELECT * FROM ({SQL['prune_median']}) WHERE (step - 25) % 5 = 0")

# Files

#: Points of a file; small, so that clouds have several.
FILE_POINTS = 20


def _cloud_files(s: SparkSession, d: str) -> DataFrame:
    folder = new_path(s, "clouds")
    cloud_files.write(A.event_points(s, d).withColumn("label", F.col("cloud_id") % 17), folder, FILE_POINTS)
    return labels.parsed(cloud_files.read(s, folder)).select(F.regexp_extract("stem", "^([0-9]+)", 1).cast("long").alias("cloud_id"), "label", *AXES)


def _metadata_csv(s: SparkSession, d: str) -> DataFrame:
    folder, table = new_path(s, "metadata"), labels.metadata_counts(_split(s, d))
    sinks.write_csv(table, folder)
    return sinks.read_csv(s, folder, table.schema)


def _layout(s: SparkSession, d: str) -> DataFrame:
    folder = new_path(s, "layout")
    sinks.write_layout(_split(s, d), folder, "split")
    return s.read.parquet(folder).where("split = 'test'")


_LAS = "path string, point_id long, x double, y double, z double, treeID long, treeSP int, completelyInside int, pointID long"


def _las_plots(s: SparkSession, d: str) -> str:
    """A folder of LAS plots; small files and ranges, so that files span tasks even here."""
    folder = new_path(s, "las")
    las.write(_plot_points(s, d).select("source", *AXES, F.col("tree_id").alias("treeID"), F.col("species").alias("treeSP"), F.col("inside").alias("completelyInside"), F.col("point_id").alias("pointID")), folder, "source", {"pointID": "u8", "treeID": "u4", "treeSP": "u1", "completelyInside": "u1"}, most=LAS_POINTS, crs="EPSG:2180")
    return folder


def _las_points(s: SparkSession, d: str) -> DataFrame:
    p = las.read(s, _las_plots(s, d), f"{_LAS}, crs string", LAS_SPLIT)
    return rounded(p.select(F.regexp_extract("path", r"(plot[0-9]+)-[^/]*$", 1).alias("source"), F.col("pointID").alias("point_id"), F.col("treeID").alias("tree_id"), F.col("treeSP").alias("species"), F.col("completelyInside").alias("inside"), *AXES, "crs"), 3)


def _las_plot_trees(s: SparkSession, d: str) -> DataFrame:
    return clean.plot_trees(_las_points(s, d).drop("crs"), 95.0)


def _las_headers(s: SparkSession, d: str) -> DataFrame:
    h = las.read(s, _las_plots(s, d), kind="headers").withColumn("source", F.regexp_extract("path", r"(plot[0-9]+)-[^/]*$", 1))
    return h.groupBy("source", "crs", "point_format").agg(F.sum("points").alias("points"))


query("las_points", _las_points, f"WITH {EV} SELECT 'plot' || (cloud_id % 5) AS source, point_id, cloud_id % 60 AS tree_id, (z % 4)::INT AS species, (point_id % 2)::INT AS inside, {', '.join(f'round({a}, 3) + 0.0 AS {a}' for a in AXES)}, 'EPSG:2180' AS crs FROM ev")
query("las_plot_trees", _las_plot_trees, SQL["plot_trees"])
query("las_headers", _las_headers, f"WITH {EV} SELECT 'plot' || (cloud_id % 5) AS source, 'EPSG:2180' AS crs, 6 AS point_format, count(*)::BIGINT AS points FROM ev GROUP BY ALL")
_SPLIT_SQL = "CASE WHEN cloud_id % 10 < 8 THEN 'train' WHEN cloud_id % 10 = 8 THEN 'test' ELSE 'val' END AS split, (cloud_id % 17)::INT AS label"


def _for_chunks(p: DataFrame) -> DataFrame:
    split = F.when(F.col("cloud_id") % 10 < 8, "train").when(F.col("cloud_id") % 10 == 8, "test").otherwise("val").alias("split")
    return p.select(split, "cloud_id", (F.col("cloud_id") % 17).cast("int").alias("label"), "point_id", *AXES)


def _chunks(s: SparkSession, d: str) -> DataFrame:
    folder = new_path(s, "chunks")
    chunks.write(_for_chunks(sampling.exact(A.event_points(s, d), POINTS)), folder, POINTS)
    return chunks.read(s, folder).drop("place")


def _relabelled(s: SparkSession, d: str) -> DataFrame:
    """Labels 15 and 16 swapped and the validation clouds taken out, each as a version; the data files stay as they are."""
    folder = new_path(s, "chunks")
    chunks.write(_for_chunks(sampling.exact(A.event_points(s, d), POINTS)), folder, POINTS)
    label = F.when(F.col("label") == 15, 16).when(F.col("label") == 16, 15).otherwise(F.col("label")).cast("int")
    manifest.change(s, folder, lambda e: e.withColumn("label", label))
    manifest.change(s, folder, lambda e: e.where("split <> 'val'"))
    return chunks.read(s, folder).drop("place")


def _rebalanced(s: SparkSession, d: str) -> DataFrame:
    """The splits of the parts' clouds, of two points each, before and after the version that moves them."""
    folder, p = new_path(s, "chunks"), A.table(s, d, "part")
    two = p.select(F.col("p_partkey").alias("cloud_id"), F.posexplode(F.array("p_size", F.length("p_name"))).alias("point_id", "x"))
    chunks.write(_for_chunks(two.select("cloud_id", "point_id", "x", F.col("x").alias("y"), F.col("x").alias("z"))), folder, 2)
    moves = lambda e: labels.rebalanced(e.select("cloud_id", "split")).select("cloud_id", F.col("new_split").alias("split"))
    after = manifest.change(s, folder, lambda e: manifest.moved(e, moves(e), "cloud_id", "split"), 1)
    return manifest.entries(s, folder, 1).select("cloud_id", "split").join(manifest.entries(s, folder, after).select("cloud_id", F.col("split").alias("new_split")), "cloud_id")


query("chunk_files", _chunks, f"WITH {EV}, ex AS (WITH {_EXACT}) SELECT cloud_id, {_SPLIT_SQL}, x, y, z FROM ex")
query("chunk_rejects", lambda s, d: chunks.write(_for_chunks(A.event_points(s, d)), new_path(s, "chunks"), POINTS), f"WITH {EV} SELECT * FROM (SELECT cloud_id, {_SPLIT_SQL.split(', (')[0]}, count(*) AS n FROM ev GROUP BY ALL) WHERE n <> {POINTS}")
query("chunk_relabel", _relabelled, f"SELECT cloud_id, split, CASE label WHEN 15 THEN 16 WHEN 16 THEN 15 ELSE label END AS label, x, y, z FROM ({SQL['chunk_files']}) WHERE split <> 'val'")
query("chunk_rebalance", _rebalanced, SQL["rebalance_split"])
query("npy_roundtrip", _cloud_files, f"WITH {EV} SELECT cloud_id, (cloud_id % 17)::INT AS label, x, y, z FROM ev")
query("metadata_csv", _metadata_csv, SQL["metadata_a_pivot"])
query("split_layout", _layout, f"{SQL['stratified_split']} WHERE split = 'test'")
_LEVELS = ", ".join(f"round(coalesce(sum(value) FILTER (view = '{v}'), 0) / {SIZE * SIZE}, 6)" for v in views.VIEWS)
query(
    "classify_clouds",
    lambda s, d: evaluate.classified(A.line_points(s, d), views.project(A.line_points(s, d), SIZE), SIZE, evaluate.view_means).select("cloud_id", F.array_join(F.transform("logits", lambda v: F.format_number(v, 5)), " ").alias("scores"), "pred"),
    f"{_views_sql('li')}, lg AS (SELECT cloud_id, [{_LEVELS}] AS logits FROM vw GROUP BY 1) SELECT cloud_id, array_to_string(list_transform(logits, lambda v: format('{{:.5f}}', v)), ' ') AS scores, (list_position(logits, list_max(logits)) - 1)::INT AS pred FROM lg",
)


def _whole_and_thinned(s: SparkSession, d: str) -> DataFrame:
    """(cloud_id, point_id, x, y, z): each large cloud, by twice its number, and a copy that has lost branches, by the number after."""
    p = A.table(s, d, "lineitem").select(F.col("l_suppkey").alias("cloud_id"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("point_id"), (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y"), (F.col("l_discount") * 100).alias("z"))
    lost = sampling.keep(p, sampling.branch_loss(), "lost")
    return p.withColumn("cloud_id", F.col("cloud_id") * 2).unionByName(lost.withColumn("cloud_id", F.col("cloud_id") * 2 + 1))


def _learned(s: SparkSession, d: str) -> DataFrame:
    """Which clouds have lost branches (label 1), by their views, learned from four fifths of the clouds; a cloud and its copy share a fold."""
    features = written(learn.view_features(views.project(_whole_and_thinned(s, d), SIZE), SIZE))
    fold = F.pmod(F.xxhash64(F.floor(F.col("cloud_id") / 2)), F.lit(5)) == 0
    rows = features.withColumns({"label": (F.col("cloud_id") % 2).cast("int"), "held_out": fold, "id": F.col("cloud_id")})
    return learn.score(learn.fit(rows.where("not held_out")), rows).select("cloud_id", "label", "held_out", "pred")


query("learned_views", _learned)
