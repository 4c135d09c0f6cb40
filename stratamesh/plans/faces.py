"""Queries of faces, neighbours across levels, borders and block indices; the SQL states them on global coordinates of each level."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import geometry as G
from ..functions import keys as K
from ..functions import materials as W
from ..functions import topology as T
from ..functions.algebra import integer, long, rounded, where
from ..operators import aggregates as A
from ..operators import faces as C
from ..operators import fields as D
from ..operators import mesh as M
from ..operators import neighbors as N
from ..operators import remap as R
from .formulas import KEY2, KEY3, LINE, STATES, _key
from .meshes import CFG, LATTICE, MIXED, S6, WIDE, base, cells_of, joined, lattice, mixed, near, placed, placed_leaves, r6
from .registry import Registry

#: A face's value in the fixture, from its place in units of its level's cells.
VALUE = "CAST((3 * ({x}) + 5 * ({y}) + {level} + {dir}) % 11 AS DOUBLE)"


def value(x: str, y: str, level: str = "level", dir: int | str = 0) -> str:
    return VALUE.format(x=x, y=y, level=level, dir=dir)


def valued(leaves):
    """All faces of the leaves with the fixture's values."""
    faces = C.face_cells(leaves, CFG)
    size = K.length(F.col("key"))
    x, y = (F.call_function("div", c, size) * 4 for c in K.octant_coords(F.col("key")))
    return faces.withColumn("v", ((3 * (x + F.col("i")) + 5 * (y + F.col("j")) + K.level(F.col("key")) + F.col("dir")) % 11).cast("double"))


def spot(key: str, prefix: str) -> list:
    """Level and leaf coordinates of a key column."""
    k = F.col(key)
    x, y = (F.call_function("div", c, K.length(k)) for c in K.octant_coords(k))
    return [K.level(k).alias(f"{prefix}level"), x.alias(f"{prefix}x"), y.alias(f"{prefix}y")]


SPAN = "CAST(pow(2, level) AS BIGINT)"


def add_all(reg: Registry) -> None:
    def on_mixed(name, build, sql):
        reg.add(name, lambda spark, d: build(*mixed(spark, d)), f"WITH {MIXED}{sql}")

    ints = lambda: [F.col(c).cast("int").alias(c) for c in ("i", "j")]
    # what lies left of a leaf, at its own level
    left = f"n0 AS (SELECT *, (lx - 1 + {SPAN}) % {SPAN} AS tx FROM leaves)"
    right = f"n1 AS (SELECT *, (lx + 1) % {SPAN} AS tx FROM leaves)"

    # Face lookup
    lookup = f""", {left}, fc AS (SELECT n0.*, CAST(i.range AS INTEGER) AS i, CAST(j.range AS INTEGER) AS j FROM n0, range(5) i, range(4) j)
SELECT f.level, f.lx, f.ly, f.i, f.j, CAST(CASE WHEN i > 0 THEN 5 WHEN s.level IS NOT NULL THEN 0 WHEN c.level IS NOT NULL THEN 1 ELSE 2 END AS INTEGER) AS status,
CASE WHEN i > 0 THEN f.level WHEN s.level IS NOT NULL THEN f.level WHEN c.level IS NOT NULL THEN f.level - 1 ELSE f.level + 1 END AS nlevel,
CASE WHEN i > 0 THEN f.lx WHEN s.level IS NOT NULL THEN tx WHEN c.level IS NOT NULL THEN tx // 2 ELSE 2 * tx + 1 END AS nx,
CASE WHEN i > 0 OR s.level IS NOT NULL THEN f.ly WHEN c.level IS NOT NULL THEN f.ly // 2 ELSE 2 * f.ly + j // 2 END AS ny,
CAST(CASE WHEN i > 0 THEN i - 1 WHEN s.level IS NOT NULL THEN 3 WHEN c.level IS NOT NULL THEN (3 + 5 * (tx % 2)) // 2 ELSE 2 END AS INTEGER) AS ti,
CAST(CASE WHEN i > 0 OR s.level IS NOT NULL THEN j WHEN c.level IS NOT NULL THEN (j + 4 * (f.ly % 2)) // 2 ELSE 2 * j % 4 END AS INTEGER) AS tj
FROM fc f LEFT JOIN leaves s ON s.level = f.level AND s.lx = tx AND s.ly = f.ly LEFT JOIN leaves c ON c.level = f.level - 1 AND c.lx = tx // 2 AND c.ly = f.ly // 2"""
    on_mixed("j_face_neighbor", lambda lv, c: placed_leaves(C.face_neighbors(C.face_cells(lv, CFG).filter("dir = 0"), lv, CFG, (-1, 0)), *ints(), "status", *spot("at", "n"), "ti", "tj"), lookup)

    # Flux halo: the same three cases on both sides
    def ghost(side: str, table: str, i: int, same: int, coarse: int, fine: int, child: int) -> str:
        kids = f"(2 * tx + {child}) * 4 + {fine}"
        pair = " + ".join(value(kids, f"2 * (ly * 4 + j) + {k}", "level + 1") for k in (0, 1))
        return f"""SELECT {side}.level, {side}.lx, {side}.ly, {i} AS i, CAST(j.range AS INTEGER) AS j, CASE WHEN s.level IS NOT NULL THEN {value(f'tx * 4 + {same}', f'{side}.ly * 4 + j.range', f'{side}.level')}
WHEN c.level IS NOT NULL THEN {value(f'tx // 2 * 4 + {coarse}', f'({side}.ly * 4 + j.range) // 2', f'{side}.level - 1')} ELSE ({pair.replace('(ly', f'({side}.ly').replace('+ j)', '+ j.range)').replace('level + 1', f'{side}.level + 1')}) / 2 END AS v
FROM {table} {side} CROSS JOIN range(4) j LEFT JOIN leaves s ON s.level = {side}.level AND s.lx = tx AND s.ly = {side}.ly LEFT JOIN leaves c ON c.level = {side}.level - 1 AND c.lx = tx // 2 AND c.ly = {side}.ly // 2"""

    on_mixed("h_flux_halo", lambda lv, c: placed_leaves(C.flux_halo(valued(lv), lv, CFG, 0), *ints(), r6("v").alias("v")), f", {left}, {right}, h AS ({ghost('a', 'n0', -1, 3, 4, 2, 1)} UNION ALL {ghost('b', 'n1', 5, 1, 0, 2, 0)}) SELECT level, lx, ly, CAST(i AS INTEGER) AS i, j, {S6('v')} AS v FROM h")

    # Faces to cells
    sides = {"l0": value("cx", "cy"), "r0": value("cx + 1", "cy"), "l1": value("cx", "cy", dir=1), "r1": value("cx", "cy + 1", dir=1)}
    on_mixed("p_face_cells", lambda lv, c: placed(C.to_cells(valued(lv), CFG), "l0", "r0", "l1", "r1"), f" SELECT level, cx, cy, {', '.join(f'{v} AS {n}' for n, v in sides.items())} FROM m")
    on_mixed("p_face_slice", lambda lv, c: C.face_slice(valued(lv), CFG, 1, 0, A.middle_line(CFG)).select(r6("position").alias("position"), "level", r6("v").alias("v")), f" SELECT {S6('(cx + 0.5) / (4 * pow(2, level))')} AS position, level, {S6(f'({sides['l1']} + {sides['r1']}) / 2')} AS v FROM m WHERE abs((cy + 0.5) / (4 * pow(2, level)) - 0.50001) < 0.5 / (4 * pow(2, level))")
    broken = f""" SELECT a.level, a.lx, a.ly, 0 AS dir, 4 AS i, CAST(j.range AS INTEGER) AS j, {value('a.lx * 4 + 4', 'a.ly * 4 + j.range', 'a.level')} AS v, {value('b.lx * 4', 'b.ly * 4 + j.range', 'b.level')} AS other FROM leaves a JOIN leaves b ON b.level = a.level AND b.ly = a.ly AND b.lx = (a.lx + 1) % CAST(pow(2, a.level) AS BIGINT), range(4) j
UNION ALL SELECT a.level, a.lx, a.ly, 1, CAST(i.range AS INTEGER), 4, {value('a.lx * 4 + i.range', 'a.ly * 4 + 4', 'a.level', 1)}, {value('b.lx * 4 + i.range', 'b.ly * 4', 'b.level', 1)} FROM leaves a JOIN leaves b ON b.level = a.level AND b.lx = a.lx AND b.ly = (a.ly + 1) % CAST(pow(2, a.level) AS BIGINT), range(4) i"""
    on_mixed("d_face_continuity", lambda lv, c: placed_leaves(C.discontinuous(valued(lv), lv, CFG), "dir", *ints(), "v", "other"), f", x AS ({broken.strip()}) SELECT level, lx, ly, CAST(dir AS INTEGER) AS dir, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, v, other FROM x WHERE abs(v - other) > 1e-12")

    # Leaves around leaves
    across = f""", {right} SELECT n1.level, n1.lx, n1.ly, CAST(CASE WHEN s.level = n1.level THEN 0 WHEN s.level < n1.level THEN 1 ELSE 2 END AS INTEGER) AS status, s.level AS nlevel, s.lx AS nx, s.ly AS ny FROM n1 JOIN leaves s
ON (s.level = n1.level AND s.lx = tx AND s.ly = n1.ly) OR (s.level = n1.level - 1 AND s.lx = tx // 2 AND s.ly = n1.ly // 2) OR (s.level = n1.level + 1 AND s.lx = 2 * tx AND s.ly // 2 = n1.ly)"""
    on_mixed("j_across_face", lambda lv, c: placed_leaves(N.across_face(lv, CFG, 1), "status", *spot("leaf", "n")), across)
    forced = f""", {right} SELECT n1.level, n1.lx, n1.ly, n1.level - 1 AS clevel, tx // 2 AS cx, n1.ly // 2 AS cy, n1.level + 1 AS flevel, 2 * tx AS fx, 2 * n1.ly AS fy, a.level IS NOT NULL AS has_coarser, b.level IS NOT NULL AS has_finer FROM n1
LEFT JOIN leaves a ON a.level = n1.level - 1 AND a.lx = tx // 2 AND a.ly = n1.ly // 2 LEFT JOIN leaves b ON b.level = n1.level + 1 AND b.lx = 2 * tx AND b.ly = 2 * n1.ly"""
    on_mixed("j_forced_level", lambda lv, c: placed_leaves(N.forced_level(lv, CFG, (1, 0)), *spot("coarser", "c"), *spot("finer", "f"), "has_coarser", "has_finer"), forced)
    masks = lambda c: c.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, cast(q % 50 as int))")).alias("mask"))
    # leaves touch if their closed boxes meet, the domain repeating on all sides
    boxes = ", k AS (SELECT level, cx // 4 AS lx, cy // 4 AS ly, bit_or(CAST(1 AS BIGINT) << CAST(q % 50 AS BIGINT)) AS mask FROM m GROUP BY 1, 2, 3), x AS (SELECT *, lx * pow(2, 5 - level) AS x0, (lx + 1) * pow(2, 5 - level) AS x1, ly * pow(2, 5 - level) AS y0, (ly + 1) * pow(2, 5 - level) AS y1 FROM k)"
    touch = " SELECT a.level, a.lx, a.ly, bit_or(b.mask) AS mask FROM x a, x b, range(3) u, range(3) v WHERE b.x0 + (u.range - 1) * 32 <= a.x1 AND b.x1 + (u.range - 1) * 32 >= a.x0 AND b.y0 + (v.range - 1) * 32 <= a.y1 AND b.y1 + (v.range - 1) * 32 >= a.y0 GROUP BY 1, 2, 3"
    on_mixed("j_presence_halo", lambda lv, c: placed_leaves(N.presence_halo(masks(c), CFG), "mask"), boxes + touch)

    # Stencils
    on_mixed("j_combination_3", lambda lv, c: placed(D.linear_combination(c, lv, CFG, "q", 0, [0.25, 0.5, -0.125]), r6("q").alias("q")), f", {near('w', -1, 0)}, {near('e', 1, 0)} SELECT m0.level, m0.cx, m0.cy, {S6('0.25 * w.v + 0.5 * m0.q - 0.125 * e.v')} AS q FROM m m0 JOIN w USING (level, cx, cy) JOIN e USING (level, cx, cy)")
    on_mixed("j_combination_5", lambda lv, c: placed(D.linear_combination(c, lv, CFG, "q", 1, [1.0, 2.0, 3.0, 4.0, 5.0]), r6("q").alias("q")), f", {near('s', 0, -1)}, {near('t', 0, 1)}, {near('ss', 0, -2)}, {near('tt', 0, 2)} SELECT m0.level, m0.cx, m0.cy, {S6('ss.v + 2 * s.v + 3 * m0.q + 4 * t.v + 5 * tt.v')} AS q FROM m m0 JOIN s USING (level, cx, cy) JOIN t USING (level, cx, cy) JOIN ss USING (level, cx, cy) JOIN tt USING (level, cx, cy)")

    def line(points: int, column: str) -> str:
        """The derivative at each place p of a block's line of 8 cells, an array a."""
        half, cases = points // 2, []
        for p in range(8):
            place = p if p < half else points - (8 - p) if p >= 8 - half else half
            cases.append(f"WHEN {p} THEN " + " + ".join(f"({x!r}) * ({column}[{p + off + 1}] - {column}[{p + 1}])" for off, x in D.one_sided(points, place).items()))
        return f"(CASE p.range {' '.join(cases)} END) * 64.0"

    along = f", hx AS (SELECT gx // 8 AS b, gy AS o, list(CAST(q AS DOUBLE) ORDER BY gx) AS a FROM l GROUP BY 1, 2), hy AS (SELECT gy // 8 AS b, gx AS o, list(CAST({{other}} AS DOUBLE) ORDER BY gy) AS a FROM l GROUP BY 1, 2), x AS (SELECT b * 8 + p.range AS cx, o AS cy, {line(5, 'a')} AS d FROM hx, range(8) p), y AS (SELECT o AS cx, b * 8 + p.range AS cy, {line(5, 'a')} AS d FROM hy, range(8) p)"
    wide = lambda spark, d: cells_of(lattice(spark, d), WIDE, 3)
    norm = "CASE WHEN sqrt(x.d * x.d + y.d * y.d) < 1e-13 THEN 1 ELSE sqrt(x.d * x.d + y.d * y.d) END"
    reg.add("d_unit_gradient", lambda spark, d: placed(D.normalized_gradient(wide(spark, d), WIDE, "q"), r6("nx").alias("nx"), r6("ny").alias("ny"), block=8), f"WITH {LATTICE}{along.format(other='q')} SELECT 3 AS level, cx, cy, {S6(f'x.d / ({norm})')} AS nx, {S6(f'y.d / ({norm})')} AS ny FROM x JOIN y USING (cx, cy)")
    reg.add("d_block_divergence", lambda spark, d: placed(D.scaled_divergence(wide(spark, d), WIDE, ["q", "n"], -0.5), r6("divergence").alias("divergence"), block=8), f"WITH {LATTICE}{along.format(other='n')} SELECT 3 AS level, cx, cy, {S6('(x.d + y.d) * -0.5')} AS divergence FROM x JOIN y USING (cx, cy)")
    for norm_name, sql in (("l1", "sum(abs(a - b)) / nullif(sum(abs(b)), 0)"), ("l2", "sqrt(sum((a - b) * (a - b))) / nullif(sqrt(sum(b * b)), 0)")):
        quotient = lambda c, k: c.select("key", "i", "j", (F.col("q") + k).cast("double").alias("q"), (F.col("n") + 1.0).alias("n"))
        reg.add(f"a_error_over_{norm_name}", lambda spark, d, k=norm_name: (lambda c: A.relative_error(quotient(c, 2), quotient(c, 0), CFG, "q", k, over="n").select(r6("error").alias("error")))(base(spark, d)), f"WITH {LATTICE}, e AS (SELECT (q + 2) / (n + 1.0) AS a, q / (n + 1.0) AS b FROM l) SELECT {S6(sql)} AS error FROM e")
    with_mat = lambda c: c.withColumn("mat", (F.col("q") % 3).cast("int"))
    on_mixed("r_material", lambda lv, c: placed(R.material_remapped(M.uniform(c.sparkSession, CFG, 4), with_mat(c), lv, CFG, "q"), "mat", r6("q").alias("q")), f" SELECT 4 AS level, cx, cy, CAST(q % 3 AS INTEGER) AS mat, {S6('q')} AS q FROM m WHERE level = 4 UNION ALL SELECT 4, cx // 2, cy // 2, CAST(q % 3 AS INTEGER), {S6('sum(q) / 4')} FROM m WHERE level = 5 GROUP BY 2, 3, 4")

    # Indices and borders
    for dim, inputs, block, brick in ((2, KEY2, (4, 6), (3, 2)), (3, KEY3, (4, 6, 2), (2, 2, 2))):
        flat = {"flat": f"CAST(l_orderkey * 31 + l_linenumber AS BIGINT) % {B.surface_cells(block)}"}
        names = "ijk"[:dim]

        def surface(P, block=block, names=names):
            coords, face, normal = B.surface_place(P, integer(P.col("flat")), block)
            return {n: integer(c) for n, c in zip(names, coords, strict=True)} | {"face": integer(face)} | {f"n{n}": integer(c) for n, c in zip(names, normal, strict=True)}

        def staggered(P, block=block, names=names):
            coords, axis = B.face_place(P, integer(P.col("flat")), block)
            return {n: integer(c) for n, c in zip(names, coords, strict=True)} | {"axis": integer(axis), "border": where(axis == 0, B.face_at_block_border(coords, 0, block), B.face_at_block_border(coords, 1, block))} | {f"r{n}": integer(c) for n, c in zip(names, B.reshaped(coords, (2,) * len(block)), strict=True)}

        reg.formula(f"g_surface_{dim}d", "lineitem", flat, LINE, surface)
        reg.formula(f"g_staggered_{dim}d", "lineitem", {"flat": flat["flat"].replace(str(B.surface_cells(block)), str(B.face_offsets(block)[-1]))}, LINE, staggered)

        def at_borders(P, dim=dim, block=block, brick=brick):
            key = _key(P, dim)
            coords = [long(P.col("tx")) + 2 * long(P.col("ty")), long(P.col("lev")) - 1, long(P.col("ty")) + 1][:dim]
            axis = 2 if dim == 2 else 0
            return {"cell": B.cell_at_domain_border(key, coords, block, brick, dim), "edge": B.edge_at_domain_border(key, coords, axis, block, brick, dim), "block_edge": B.edge_at_block_border(coords, axis, block), "surface": B.edge_at_surface(coords, axis, block, 2), "corner": B.edge_at_block_edge(coords, axis, block, 2, 3 if dim == 2 else 4)}

        reg.formula(f"g_borders_{dim}d", "lineitem", inputs, LINE, at_borders)
    corners = {f"c{i}": f"CAST((l_partkey * {i} + l_suppkey) % 3 * (l_linenumber % 2) AS INTEGER)" for i in range(8)}
    reg.formula("g_regions", "lineitem", corners, LINE, lambda P: {"pure2": B.fully_inside([P.col(f"c{i}") for i in range(4)]), "pure3": B.fully_inside([P.col(f"c{i}") for i in range(8)]), "some1": B.overlaps([P.col(f"c{i}") for i in range(4)], 1)})
    reg.formula("a_arg_min", "lineitem", {k: STATES[k] for k in ("u1", "v1", "w1")}, LINE, lambda P: {"of2": integer(B.arg_min(P, P.col("u1"), P.col("v1"))), "of3": integer(B.arg_min(P, P.col("u1"), P.col("v1"), P.col("w1")))})
    for dim, inputs, sizes in ((2, KEY2, (4, 4)), (3, KEY3, (4, 4, 4))):

        def composed(P, dim=dim, sizes=sizes):
            key = _key(P, dim)
            at = [long(P.col("tx")), long(P.col("ty")) + 1, long(P.col("lev")) % 4][:dim]
            low = (-1.0, 0.5, 2.0)[:dim]
            return {f"{kind}{'xyz'[a]}": rounded(c, 9) for kind, coords in (("f", G.face_centre(key, at, 1, sizes, dim)), ("e", G.edge_centre(key, at, 0, sizes, dim))) for a, c in enumerate(G.real_space(coords, low, 2.5))}

        reg.formula(f"g_real_faces_{dim}d", "lineitem", inputs, LINE, composed)
    topology = "e AS (SELECT CAST(range AS INTEGER) AS e FROM range(12)), c AS (SELECT CAST(range AS INTEGER) AS c FROM range(8))"
    reg.add("g_topology", lambda spark, d: spark.createDataFrame(T.rows(), "kind string, dim int, number int, face int, other int"), f"WITH {topology} SELECT 'edge' AS kind, 3 AS dim, e AS number, CASE WHEN e < 4 OR e >= 8 THEN e % 2 ELSE 2 + e % 2 END AS face, CASE WHEN e < 4 THEN 2 + e // 2 % 2 ELSE 4 + e // 2 % 2 END AS other FROM e UNION ALL SELECT 'corner', 2, c, c % 2, 2 + c // 2 FROM c WHERE c < 4 UNION ALL SELECT 'corner', 3, c, c % 2, 2 + c // 2 % 2 FROM c UNION ALL SELECT 'corner', 3, c, c % 2, 4 + c // 4 FROM c UNION ALL SELECT 'corner', 3, c, 2 + c // 2 % 2, 4 + c // 4 FROM c")
    words = {f"w{i}": f"CAST(l_orderkey * {2654435761 + 2 * i} % 4611686018427387904 AS BIGINT)" for i in range(2)} | {f"o{i}": f"CAST(l_partkey * {40503 + 2 * i} * 65537 % 4611686018427387904 AS BIGINT)" for i in range(2)}

    def wide_sets(P):
        a, b = [P.col("w0"), P.col("w1")], [P.col("o0"), P.col("o1")]
        both, either, put, cut = W.wide_intersection(a, b), W.wide_union(a, b), W.wide_with(a, 96), W.wide_without(a, 3)
        return {"both0": both[0], "both1": both[1], "either0": either[0], "either1": either[1], "put96": put[1], "cut3": cut[0], "n": long(W.wide_count(a)), "has96": W.wide_has(W.wide_with(a, 96), 96), "index96": long(W.wide_index_of(put, 96)), "index70": long(W.wide_index_of(a, 70))}

    reg.formula("v_materials_wide", "lineitem", words, LINE, wide_sets)
    aged = lambda c: c.groupBy("key").agg(F.sum("q").alias("q")).select("key", F.lit(-1).alias("flag"), (F.col("q") % 9 - 1).cast("int").alias("age"))
    reg.add("m_coarsen_delay", lambda spark, d: placed_leaves(M.coarsen(aged(base(spark, d)), CFG, 2), "flag"), f"WITH {LATTICE}, b AS (SELECT gx // 4 AS lx, gy // 4 AS ly, CAST(sum(q) AS BIGINT) % 9 - 1 AS age FROM l GROUP BY 1, 2), k AS (SELECT lx // 2 AS fx, ly // 2 AS fy FROM b WHERE NOT age BETWEEN 0 AND 2 GROUP BY 1, 2 HAVING count(*) = 4) SELECT 3 AS level, fx AS lx, fy AS ly, 0 AS flag FROM k UNION ALL SELECT 4, lx, ly, -1 FROM b WHERE NOT EXISTS (SELECT 1 FROM k WHERE fx = lx // 2 AND fy = ly // 2)")
    on_mixed("r_leaf", lambda lv, c: placed_leaves(R.leaf_remapped(M.uniform(c.sparkSession, CFG, 4), c.groupBy("key").agg(F.sum("q").alias("q")), CFG, ["q"]), r6("q").alias("q")), f", lb AS (SELECT level, cx // 4 AS lx, cy // 4 AS ly, sum(q) AS q FROM m GROUP BY 1, 2, 3) SELECT 4 AS level, lx, ly, {S6('q')} AS q FROM lb WHERE level = 4 UNION ALL SELECT 4, lx // 2, ly // 2, {S6('avg(q)')} FROM lb WHERE level = 5 GROUP BY 2, 3")

    # The curvature chain on one level: blocks of 8, 7 points, one round of the filter
    def chain(spark, d):
        cells = cells_of(lattice(spark, d), WIDE, 3).select("key", "i", "j", ((F.col("q") % 9 + 1) / 10.0).alias("phi"))
        leaves = cells.select("key").distinct()
        return placed(D.smooth_interface_curvature(cells, leaves, WIDE, rounds=1), (F.round(F.col("curvature") * 1e3) / 1e3).alias("curvature"), block=8)

    def along_both(name: str, x: str, y: str, source: str) -> str:
        """Derivatives of two columns of a table (cx, cy) within blocks of 8: <name>x along x, <name>y along y."""
        return f"{name}hx AS (SELECT cx // 8 AS b, cy AS o, list({x} ORDER BY cx) AS a FROM {source} GROUP BY 1, 2), {name}hy AS (SELECT cy // 8 AS b, cx AS o, list({y} ORDER BY cy) AS a FROM {source} GROUP BY 1, 2), {name}x AS (SELECT b * 8 + p.range AS cx, o AS cy, {line(7, 'a')} AS d FROM {name}hx, range(8) p), {name}y AS (SELECT o AS cx, b * 8 + p.range AS cy, {line(7, 'a')} AS d FROM {name}hy, range(8) p)"

    start = f"ph AS (SELECT gx AS cx, gy AS cy, (q % 9 + 1) / 10.0 AS phi FROM l), sm AS (SELECT cx, cy, pow(phi, 0.1) / (pow(phi, 0.1) + pow(1 - phi, 0.1)) AS s FROM ph)"
    unit = "un AS (SELECT cx, cy, sx.d / CASE WHEN sqrt(sx.d * sx.d + sy.d * sy.d) < 1e-13 THEN 1 ELSE sqrt(sx.d * sx.d + sy.d * sy.d) END AS nx, sy.d / CASE WHEN sqrt(sx.d * sx.d + sy.d * sy.d) < 1e-13 THEN 1 ELSE sqrt(sx.d * sx.d + sy.d * sy.d) END AS ny FROM sx JOIN sy USING (cx, cy))"
    bent = "k AS (SELECT cx, cy, -(nx.d + ny.d) AS c, pow(phi, 2) * pow(1 - phi, 2) AS w FROM nx JOIN ny USING (cx, cy) JOIN ph USING (cx, cy))"
    ring = "o AS (SELECT a.range - 1 AS dx, b.range - 1 AS dy FROM range(3) a, range(3) b), f1 AS (SELECT k.cx, k.cy, any_value(k.c) AS own, any_value(k.w) AS w, sum(z.w * z.c) / sum(z.w) AS mean FROM k, o JOIN k z ON z.cx = (k.cx + dx + 64) % 64 AND z.cy = (k.cy + dy + 64) % 64 GROUP BY 1, 2)"
    reg.add("d_interface_chain", chain, f"WITH {LATTICE}, {start}, {along_both('s', 's', 's', 'sm')}, {unit}, {along_both('n', 'nx', 'ny', 'un')}, {bent}, {ring} SELECT 3 AS level, cx, cy, round(CASE WHEN w > 1e-6 THEN mean ELSE own END * 1e3) / 1e3 AS curvature FROM f1")
