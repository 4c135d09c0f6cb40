"""Queries of mesh operators over fixtures made from line items.

The fixture is a lattice of 64 x 64 cells (order and part keys modulo 64) in 16 x 16 leaves of 4 x 4 cells at level 4; the mixed mesh refines each leaf
whose line count is above the mean. The SQL states the same operators on global cell coordinates of each level.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import aggregates as A
from ..operators import fields as D
from ..operators import halo as H
from ..operators import mesh as M
from ..operators import neighbors as N
from ..operators import remap as R
from .cuts import cut
from .registry import Registry

CFG = M.Config(dim=2, brick=(1, 1), periodic=(True, True), block=(4, 4), level_min=2, level_max=6)
CLOSED = replace(CFG, periodic=(False, False))
WIDE = replace(CFG, block=(8, 8))


def r6(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.500131) / 1e6


def S6(text: str) -> str:
    return f"(CAST(floor(CAST({text} AS DOUBLE) * 1e6 + 0.500131) AS DOUBLE) / 1e6)"


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") % 64).alias("gx"), (F.col("l_partkey") % 64).alias("gy"), F.round("l_quantity").cast("long").alias("q"))
    sums = rows.groupBy("gx", "gy").agg(F.sum("q").alias("q"), F.count("*").alias("n"))
    every = spark.range(4096).select((F.col("id") % 64).alias("gx"), F.call_function("div", F.col("id"), F.lit(64)).alias("gy"))
    return every.join(F.broadcast(sums), ["gx", "gy"], "left").select("gx", "gy", F.coalesce("q", F.lit(0)).alias("q"), F.coalesce("n", F.lit(0)).alias("n"))  # sums: 4096 rows at most


def cells_of(points: DataFrame, cfg: M.Config, level: int) -> DataFrame:
    b = cfg.block[0]
    corner = [F.call_function("shiftleft", F.call_function("div", F.col(c), F.lit(b)), F.lit(K.LAYOUTS[2].max_level - level)) for c in ("gx", "gy")]
    return points.select(K.encode([0, 0], corner, F.lit(level)).alias("key"), (F.col("gx") % b).cast("int").alias("i"), (F.col("gy") % b).cast("int").alias("j"), "q", "n")


def base(spark, sf_dir):
    return cells_of(lattice(spark, sf_dir), CFG, 4)


def mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(leaves, cells with q) of the mixed mesh."""
    cells = base(spark, sf_dir)
    sums = cells.groupBy("key").agg(F.sum("n").alias("n"))
    flagged = sums.crossJoin(F.broadcast(sums.agg(F.sum("n").alias("t")))).select("key", (F.col("n") * 256 > F.col("t")).cast("int").alias("flag"))  # one row of totals
    leaves = M.refine(flagged, CFG).select("key")
    out = R.remapped(leaves, cells, sums.select("key"), CFG, ["q"])
    fine = K.level(F.col("key")) == 5
    # both are used several times in each query: written once
    return cut(leaves), cut(out.withColumn("q", F.col("q") + F.when(fine, F.col("i") % 2 + 2 * (F.col("j") % 2)).otherwise(0)))


def placed(df: DataFrame, *names, block: int = 4) -> DataFrame:
    """level, cx, cy and the named columns."""
    level = K.level(F.col("key"))
    size = K.length(F.col("key"))
    cx, cy = (F.call_function("div", c, size) * block for c in K.octant_coords(F.col("key")))
    return df.select(level.alias("level"), (cx + F.col("i")).alias("cx"), (cy + F.col("j")).alias("cy"), *names)


def placed_leaves(df: DataFrame, *names) -> DataFrame:
    size = K.length(F.col("key"))
    x, y = (F.call_function("div", c, size) for c in K.octant_coords(F.col("key")))
    return df.select(K.level(F.col("key")).alias("level"), x.alias("lx"), y.alias("ly"), *names)


LATTICE = """l AS (SELECT g.gx, g.gy, coalesce(s.q, 0) AS q, coalesce(s.n, 0) AS n FROM (SELECT a.range AS gx, b.range AS gy FROM range(64) a, range(64) b) g
LEFT JOIN (SELECT l_orderkey % 64 AS gx, l_partkey % 64 AS gy, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2) s ON g.gx = s.gx AND g.gy = s.gy)"""
MIXED = (
    LATTICE
    + """, b AS (SELECT gx // 4 AS lx, gy // 4 AS ly, sum(n) AS n FROM l GROUP BY 1, 2), f AS (SELECT lx, ly, n * 256 > (SELECT sum(n) FROM b) AS fine FROM b),
leaves AS (SELECT 4 AS level, lx, ly FROM f WHERE NOT fine UNION ALL SELECT 5, 2 * lx + a.range, 2 * ly + c.range FROM f, range(2) a, range(2) c WHERE fine),
m AS (SELECT 4 AS level, gx AS cx, gy AS cy, CAST(q AS DOUBLE) AS q FROM l JOIN f ON lx = gx // 4 AND ly = gy // 4 WHERE NOT fine
UNION ALL SELECT 5, 2 * gx + a.range, 2 * gy + c.range, q + a.range + 2 * c.range FROM l JOIN f ON lx = gx // 4 AND ly = gy // 4, range(2) a, range(2) c WHERE fine)"""
)


def near(name: str, dx: int, dy: int, source: str = "m", value: str = "q", closed: bool = False) -> str:
    """A CTE of the value one step away in each cell: same level, the coarser cell around, the mean of the finer ones, or the cell's own."""
    span = "(CAST(pow(2, level) AS BIGINT) * 4)"
    tx, ty = f"((cx + {dx} + {span}) % {span})", f"((cy + {dy} + {span}) % {span})"
    out = f"(cx + {dx} < 0 OR cx + {dx} >= {span} OR cy + {dy} < 0 OR cy + {dy} >= {span})" if closed else "FALSE"
    return f"""{name}_t AS (SELECT level, cx, cy, {value} AS own, {tx} AS tx, {ty} AS ty, {out} AS beyond FROM {source}),
{name} AS (SELECT t.level, t.cx, t.cy, CASE WHEN t.beyond THEN t.own ELSE coalesce(a.{value}, b.{value}, c.v, t.own) END AS v FROM {name}_t t
LEFT JOIN {source} a ON a.level = t.level AND a.cx = t.tx AND a.cy = t.ty
LEFT JOIN {source} b ON b.level = t.level - 1 AND b.cx = t.tx // 2 AND b.cy = t.ty // 2
LEFT JOIN (SELECT level, cx // 2 AS hx, cy // 2 AS hy, avg({value}) AS v FROM {source} GROUP BY 1, 2, 3) c ON c.level = t.level + 1 AND c.hx = t.tx AND c.hy = t.ty)"""


def sides(source: str = "m", value: str = "q", closed: bool = False, prefix: str = "") -> str:
    return ", ".join(near(f"{prefix}{n}", dx, dy, source, value, closed) for n, dx, dy in (("w", -1, 0), ("e", 1, 0), ("s", 0, -1), ("t", 0, 1)))


def joined(columns: str, source: str = "m", prefix: str = "") -> str:
    on = " ".join(f"JOIN {prefix}{n} {prefix}{n} ON {prefix}{n}.level = m0.level AND {prefix}{n}.cx = m0.cx AND {prefix}{n}.cy = m0.cy" for n in "west")
    return f"SELECT m0.level, m0.cx, m0.cy, {columns} FROM {source} m0 {on}"


DX = "(1.0 / (4 * pow(2, m0.level)))"
GRADIENT = f"sqrt(pow((e.v - w.v) / (2 * {DX}), 2) + pow((t.v - s.v) / (2 * {DX}), 2))"


def add_all(reg: Registry) -> None:
    def on_mixed(name, build, sql):
        reg.add(name, lambda spark, d: build(*mixed(spark, d)), f"WITH {MIXED}{sql}")

    def on_base(name, build, sql):
        reg.add(name, lambda spark, d: build(base(spark, d)), f"WITH {LATTICE}{sql}")

    # Reductions
    def flagship(leaves, cells):
        shares = A.level_histogram(leaves, CFG)
        sums = cells.groupBy(K.level(F.col("key")).alias("level")).agg(F.sum(A.volume(CFG) * F.col("q")).alias("q"))
        return shares.join(sums, "level").select("level", "leaves", r6("share").alias("share"), r6("volume_share").alias("volume_share"), r6("q").alias("integral"))

    hist = " , h AS (SELECT level, count(*) AS leaves FROM leaves GROUP BY level)"
    on_mixed("flagship_level_integral", flagship, f"{hist}, v AS (SELECT level, sum(q * pow(1.0 / (4 * pow(2, level)), 2)) AS q FROM m GROUP BY level) SELECT h.level, leaves, {S6('leaves / (SELECT sum(leaves) FROM h)')} AS share, {S6('leaves / pow(4, h.level)')} AS volume_share, {S6('v.q')} AS integral FROM h JOIN v ON v.level = h.level")
    on_mixed("a_level_hist", lambda lv, c: A.level_histogram(lv, CFG).select("level", "leaves", r6("share").alias("share"), r6("volume_share").alias("volume_share")), f"{hist} SELECT level, leaves, {S6('leaves / (SELECT sum(leaves) FROM h)')} AS share, {S6('leaves / pow(4, level)')} AS volume_share FROM h")
    on_mixed("a_volume_integral", lambda lv, c: A.volume_integrals(c, CFG, ["q"]).select(r6("q").alias("q")), f" SELECT {S6('sum(q * pow(1.0 / (4 * pow(2, level)), 2))')} AS q FROM m")
    on_mixed("a_sparsity", lambda lv, c: A.sparsity(lv, CFG).select(r6("sparsity").alias("sparsity")), f" SELECT {S6('count(*) / pow(4, max(level))')} AS sparsity FROM leaves")
    on_mixed("a_material_integral", lambda lv, c: A.material_integrals(c.withColumn("mat", (F.col("q") % 3).cast("int")), CFG, "q").select("mat", r6("q").alias("q")), f" SELECT CAST(q % 3 AS INTEGER) AS mat, {S6('sum(q * pow(1.0 / (4 * pow(2, level)), 2))')} AS q FROM m GROUP BY 1")
    on_mixed("a_index_in_level", lambda lv, c: placed_leaves(M.indexed(lv, CFG), "index_in_level"), " , z AS (SELECT *, list_reduce([(((lx >> i) & 1) << (2 * i)) | (((ly >> i) & 1) << (2 * i + 1)) for i in range(6)], lambda x, y: x + y) AS mo FROM leaves) SELECT level, lx, ly, row_number() OVER (PARTITION BY level ORDER BY mo) - 1 AS index_in_level FROM z")
    for norm, sql in (("l1", "sum(abs(q + n - q)) / nullif(sum(abs(q)), 0)"), ("l2", "sqrt(sum(n * n)) / nullif(sqrt(sum(q * q)), 0)")):
        on_base(f"a_error_{norm}", lambda c, n=norm: A.relative_error(c.select("key", "i", "j", (F.col("q") + F.col("n")).alias("q")), c, CFG, "q", n).select(r6("error").alias("error")), f" SELECT {S6(sql)} AS error FROM l")
    on_base("a_conservativity", lambda c: A.conservation(c, c.withColumn("q", F.col("q") + F.col("n")), CFG, ["q", "n"]).select("name", *[r6(x).alias(x) for x in ("reference", "test", "absolute", "relative")]), f" SELECT name, {S6('r')} AS reference, {S6('t')} AS test, {S6('abs(t - r)')} AS absolute, {S6('abs(t - r) / abs(r)')} AS relative FROM (SELECT 'q' AS name, sum(q) / 4096 AS r, sum(q + n) / 4096 AS t FROM l UNION ALL SELECT 'n', sum(n) / 4096, sum(n) / 4096 FROM l)")
    on_mixed("a_min_dt", lambda lv, c: A.time_step(c, CFG, F.col("q") + 1.0, 0.5, 0.0, 1.0).select(r6(F.col("dt") * 1000).alias("dt")), f" SELECT {S6('least(min(1.0 / (4 * pow(2, level)) / (q + 1)) * 0.5, 1.0) * 1000')} AS dt FROM m")
    reg.add("a_reductions", lambda spark, d: A.reductions(spark.read.parquet(f"{d}/part.parquet"), "p_size").select("min", "max", "sum", "bor", "band", "lor", "land", "prod"), "SELECT min(p_size) AS min, max(p_size) AS max, CAST(sum(p_size) AS BIGINT) AS sum, bit_or(p_size) AS bor, bit_and(p_size) AS band, bool_or(p_size <> 0) AS lor, bool_and(p_size <> 0) AS land, product(CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE -1.0 END) AS prod FROM part")
    reg.add("a_binomials", lambda spark, d: A.binomials(spark, 12), "SELECT CAST(n.range AS INTEGER) AS n, CAST(k.range AS INTEGER) AS k, CAST(round(factorial(CAST(n.range AS INTEGER)) / (factorial(CAST(k.range AS INTEGER)) * factorial(CAST(n.range - k.range AS INTEGER)))) AS BIGINT) AS value FROM range(13) n, range(13) k WHERE k.range <= n.range")
    reg.add("a_offsets", lambda spark, d: A.offsets(spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("n")), F.col("o_custkey"), "o_orderkey", "n"), 'SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM orders')
    sums = lambda c: c.groupBy("key").agg(F.sum("q").alias("q"))
    wish = lambda c: sums(c).select("key", F.when(F.col("q") % 3 == 0, 1).when(F.col("q") % 3 == 1, -1).otherwise(0).alias("flag"))
    leaf_sql = ", b AS (SELECT gx // 4 AS lx, gy // 4 AS ly, CAST(sum(q) AS BIGINT) AS q FROM l GROUP BY 1, 2), g AS (SELECT lx, ly, CASE q % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS flag FROM b)"
    on_base("a_flag_counts", lambda c: A.flag_counts(wish(c)), f"{leaf_sql} SELECT flag, count(*) AS leaves FROM g GROUP BY flag")

    # Adaptation
    reg.add("m_uniform", lambda spark, d: placed_leaves(M.uniform(spark, CFG, 5)), "SELECT 5 AS level, a.range AS lx, b.range AS ly FROM range(32) a, range(32) b")
    on_base("m_refine", lambda c: placed_leaves(M.refine(wish(c), CFG), "flag"), f"{leaf_sql} SELECT 4 AS level, lx, ly, flag FROM g WHERE flag <> 1 UNION ALL SELECT 5, 2 * lx + a.range, 2 * ly + c.range, 0 FROM g, range(2) a, range(2) c WHERE flag = 1")
    merge = lambda c: sums(c).select("key", F.when(F.col("q") % 7 > 0, -1).otherwise(0).alias("flag"))
    merge_sql = ", b AS (SELECT gx // 4 AS lx, gy // 4 AS ly, CAST(sum(q) AS BIGINT) AS q FROM l GROUP BY 1, 2), g AS (SELECT lx, ly, CASE WHEN q % 7 > 0 THEN -1 ELSE 0 END AS flag FROM b), k AS (SELECT lx // 2 AS fx, ly // 2 AS fy FROM g WHERE flag = -1 GROUP BY 1, 2 HAVING count(*) = 4)"
    on_base("m_coarsen", lambda c: placed_leaves(M.coarsen(merge(c), CFG), "flag"), f"{merge_sql} SELECT 3 AS level, fx AS lx, fy AS ly, 0 AS flag FROM k UNION ALL SELECT 4, lx, ly, flag FROM g WHERE NOT EXISTS (SELECT 1 FROM k WHERE fx = lx // 2 AND fy = ly // 2)")

    def deep(spark, d):
        """One corner refined four times on a level 2 mesh: far from balanced."""
        leaves = M.uniform(spark, CFG, 2)
        for level in range(2, 6):
            x, y = K.octant_coords(F.col("key"))
            corner = (x == 0) & (y == 0) & (K.level(F.col("key")) == level)
            leaves = cut(M.refine(leaves.select("key", corner.cast("int").alias("flag")), CFG).select("key"))
        return leaves

    reg.add("m_balance", lambda spark, d: placed_leaves(M.balance(deep(spark, d), CFG)))
    reg.add("m_adapt", lambda spark, d: placed_leaves(M.adapt(wish(base(spark, d)), CFG)[0]))
    reg.add("m_is_balanced", lambda spark, d: spark.createDataFrame([(M.is_balanced(deep(spark, d), CFG), M.is_balanced(M.balance(deep(spark, d), CFG), CFG))], "before boolean, after boolean"), "SELECT FALSE AS before, TRUE AS after")
    morton = "list_reduce([(((lx >> i) & 1) << (2 * i)) | (((ly >> i) & 1) << (2 * i + 1)) for i in range(4)], lambda x, y: x + y)"
    weights = f", b AS (SELECT gx // 4 AS lx, gy // 4 AS ly, CAST(sum(n) AS BIGINT) AS w FROM l GROUP BY 1, 2), o AS (SELECT lx, ly, w, sum(w) OVER (ORDER BY {morton}) - w AS before, sum(w) OVER () AS whole FROM b)"
    on_base("m_partition_weighted", lambda c: placed_leaves(M.partitioned(c.groupBy("key").agg(F.sum("n").alias("weight")), 7), "weight", "part"), f"{weights} SELECT 4 AS level, lx, ly, w AS weight, CAST(least(floor(CAST(before * 7 AS DOUBLE) / greatest(whole, 1)), 6) AS INTEGER) AS part FROM o")
    on_base("m_partition", lambda c: placed_leaves(M.partitioned(c.select("key").distinct().withColumn("weight", F.lit(1).cast("long")), 7), "part"), f", b AS (SELECT DISTINCT gx // 4 AS lx, gy // 4 AS ly FROM l), o AS (SELECT lx, ly, row_number() OVER (ORDER BY {morton}) - 1 AS before FROM b) SELECT 4 AS level, lx, ly, CAST(floor(before * 7 / 256.0) AS INTEGER) AS part FROM o")
    on_mixed("m_nodes", lambda lv, c: M.nodes(lv, CFG), " SELECT DISTINCT CAST((lx + a.range) * pow(2, 22 - level) AS BIGINT) AS x, CAST((ly + c.range) * pow(2, 22 - level) AS BIGINT) AS y FROM leaves, range(2) a, range(2) c")
    numbers = "t AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1), (4, 2, 0), (5, 2, 1)) v(tree, x, y))"
    moved = "CASE f.range WHEN 0 THEN (x + 2) % 3 WHEN 1 THEN (x + 1) % 3 ELSE x END AS tx, CASE f.range WHEN 2 THEN greatest(y - 1, 0) WHEN 3 THEN least(y + 1, 1) ELSE y END AS ty"
    reg.add("g_brick_connectivity", lambda spark, d: spark.createDataFrame(M.brick_connectivity(M.Config(brick=(3, 2), periodic=(True, False))), "tree int, face int, to int"), f'WITH {numbers}, s AS (SELECT tree, CAST(f.range AS INTEGER) AS face, {moved} FROM t, range(4) f) SELECT s.tree, face, t.tree AS "to" FROM s JOIN t ON t.x = tx AND t.y = ty')

    # Neighbours
    def status_sql(closed: bool) -> str:
        n = "CAST(pow(2, level) AS BIGINT)"
        out = f"(lx + dx < 0 OR lx + dx >= {n} OR ly + dy < 0 OR ly + dy >= {n})" if closed else "FALSE"
        return f""", d AS (SELECT a.range - 1 AS dx, c.range - 1 AS dy FROM range(3) a, range(3) c WHERE a.range <> 1 OR c.range <> 1),
p AS (SELECT level, lx, ly, dx, dy, (lx + dx + {n}) % {n} AS tx, (ly + dy + {n}) % {n} AS ty, {out} AS beyond FROM leaves, d),
st AS (SELECT p.*, CASE WHEN beyond THEN 3 WHEN a.level IS NOT NULL THEN 0 WHEN b.level IS NOT NULL THEN 1 WHEN c.level IS NOT NULL THEN 2 ELSE 4 END AS status FROM p LEFT JOIN leaves a ON a.level = p.level AND a.lx = tx AND a.ly = ty
LEFT JOIN leaves b ON b.level = p.level - 1 AND b.lx = tx // 2 AND b.ly = ty // 2
LEFT JOIN leaves c ON c.level = p.level + 1 AND c.lx = 2 * tx + (dx < 0)::INT AND c.ly = 2 * ty + (dy < 0)::INT)"""

    for name, cfg in (("open", CFG), ("closed", CLOSED)):
        on_mixed(f"j_neighbor_{name}", lambda lv, c, cfg=cfg: placed_leaves(N.leaf_neighbors(lv, cfg), "dx", "dy", "status"), f"{status_sql(name == 'closed')} SELECT level, lx, ly, dx, dy, status FROM st")
    faces = ", ".join(f"max(CASE WHEN dx = {dx} AND dy = {dy} THEN status END) AS s_{'m0p'[dx + 1]}{'m0p'[dy + 1]}" for dx, dy in ((-1, 0), (0, -1), (0, 1), (1, 0)))
    on_mixed("j_conformal", lambda lv, c: placed_leaves(N.conformal(lv, CLOSED), "s_m0", "s_0m", "s_0p", "s_p0"), f"{status_sql(True)} SELECT level, lx, ly, {faces} FROM st GROUP BY 1, 2, 3")
    eight = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    label = lambda a, b: f"s_{'m0p'[a + 1]}{'m0p'[b + 1]}"
    packed = " + ".join(f"max(CASE WHEN dx = {a} AND dy = {b} THEN least(status, 3) END) * {4**i}" for i, (a, b) in enumerate(eight))
    on_mixed("j_conformal_full", lambda lv, c: placed_leaves(N.conformal(lv, CLOSED, False).withColumn("packed", N.packed_status([F.col(label(a, b)) for a, b in eight])), "packed"), f"{status_sql(True)} SELECT level, lx, ly, CAST({packed} AS BIGINT) AS packed FROM st GROUP BY 1, 2, 3")
    on_mixed("j_outside", lambda lv, c: placed_leaves(M.outside(lv, CLOSED).withColumn("outside", K.outside_status(F.col("key"))), "outside"), f"{status_sql(True)} SELECT DISTINCT level, tx AS lx, ty AS ly, CAST((lx + dx < 0 OR lx + dx >= pow(2, level))::INT + 2 * (ly + dy < 0 OR ly + dy >= pow(2, level))::INT AS BIGINT) AS outside FROM st WHERE beyond")
    for name, dx, dy, cfg in (("right", 1, 0, CFG), ("left_closed", -1, 0, CLOSED), ("corner", 1, 1, CFG)):
        on_mixed(f"j_cell_{name}", lambda lv, c, s=(dx, dy), cfg=cfg: placed(N.shifted(c, lv, cfg, s, ["q"], "_n"), r6("q_n").alias("q_n")), f", {near('x', dx, dy, closed=name == 'left_closed')} SELECT level, cx, cy, {S6('v')} AS q_n FROM x")

    # Fields
    on_mixed("d_divergence", lambda lv, c: placed(D.divergence(c.withColumn("p", F.col("q") * 2), lv, CFG, ["q", "p"]), r6("divergence").alias("divergence")), f", {sides()} {joined(S6(f'(e.v - w.v + 2 * (t.v - s.v)) / {DX}') + ' AS divergence')}")
    on_mixed("d_divergence_closed", lambda lv, c: placed(D.divergence(c.withColumn("p", F.col("q") * 2), lv, CLOSED, ["q", "p"], True), r6("divergence").alias("divergence")), f", {sides(closed=True)} {joined(S6(f'(e.v - w.v + 2 * (t.v - s.v)) / {DX} * 0.5') + ' AS divergence')}")
    on_mixed("d_gradient", lambda lv, c: placed(D.gradient_norm(c, lv, CFG, "q"), r6("gradient").alias("gradient")), f", {sides()} {joined(S6(GRADIENT) + ' AS gradient')}")
    scaled = {"none": "g", "linear": "g / m", "sqrt": "sqrt(g / m)", "log": "CASE WHEN g > 0 THEN ln(g / m) ELSE 0 END", "exp": "exp(-10.0 * g / m)"}
    for kind, sql in scaled.items():
        on_mixed(f"d_schlieren_{kind}", lambda lv, c, k=kind: placed(D.schlieren(c, lv, CFG, "q", k), r6("schlieren").alias("schlieren")), f", {sides()}, gr AS ({joined(GRADIENT + ' AS g')}) SELECT level, cx, cy, {S6(sql)} AS schlieren FROM gr, (SELECT max(g) AS m FROM gr)")
    o = lambda a, b: f"abs({a}.v - 2 * m0.q + {b}.v)"
    u = lambda a, b: f"(abs({b}.v - m0.q) + abs(m0.q - {a}.v) + 0.01 * (abs({a}.v) + 2 * abs(m0.q) + abs({b}.v)) + 1e-12)"
    split_x, split_y = f"{o('w', 'e')} / {u('w', 'e')}", f"{o('s', 't')} / {u('s', 't')}"
    unsplit = f"sqrt((pow({o('w', 'e')}, 2) + pow({o('s', 't')}, 2)) / (pow({u('w', 'e')}, 2) + pow({u('s', 't')}, 2)))"
    jump = lambda x: f"CASE WHEN greatest(abs(m0.q), abs({x}.v)) < 1e-3 THEN 0 ELSE least(abs(m0.q - {x}.v) / greatest(abs(m0.q), abs({x}.v)), 1) END"
    ind = lambda lv, c, k: D.indicator(c, lv, CFG, "q", k)
    on_mixed("m_lohner_split", lambda lv, c: placed(ind(lv, c, "lohner_split"), r6(F.col("indicators")[0]).alias("ix"), r6(F.col("indicators")[1]).alias("iy")), f", {sides()} {joined(S6(split_x) + ' AS ix, ' + S6(split_y) + ' AS iy')}")
    on_mixed("m_lohner_unsplit", lambda lv, c: placed(ind(lv, c, "lohner_unsplit"), r6(F.col("indicators")[0]).alias("i0")), f", {sides()} {joined(S6(unsplit) + ' AS i0')}")
    on_mixed("m_gradient", lambda lv, c: placed(ind(lv, c, "gradient"), r6(F.col("indicators")[0]).alias("i0")), f", {sides()} {joined(S6('greatest(' + ', '.join(map(jump, 'west')) + ')') + ' AS i0')}")
    on_mixed("m_affine", lambda lv, c: placed(D.indicator(c, lv, CFG, "q", "affine", a=0.5, b=1.0), r6(F.col("indicators")[0]).alias("i0")), f" SELECT level, cx, cy, {S6('q * 0.5 + 1')} AS i0 FROM m")
    on_mixed("m_flags", lambda lv, c: placed_leaves(D.flags(ind(lv, c, "lohner_unsplit"), CFG, 0.9, 0.6), "flag"), f", {sides()}, i AS ({joined(unsplit + ' AS x')}) SELECT level, cx // 4 AS lx, cy // 4 AS ly, max(CASE WHEN level < 6 AND x > 0.9 THEN 1 WHEN level > 2 AND x < 0.6 THEN -1 ELSE 0 END) AS flag FROM i GROUP BY 1, 2, 3")
    on_mixed("d_smooth", lambda lv, c: placed(c, r6(D.smooth_interface((F.col("q") % 9 + 1) / 10.0)).alias("s")), f" SELECT level, cx, cy, {S6('pow((q % 9 + 1) / 10.0, 0.1) / (pow((q % 9 + 1) / 10.0, 0.1) + pow(1 - (q % 9 + 1) / 10.0, 0.1))')} AS s FROM m")
    four = ", ".join(near(n, dx, dy) for n, dx, dy in (("w", -1, 0), ("e", 1, 0), ("s", 0, -1), ("t", 0, 1), ("ww", -2, 0), ("ee", 2, 0), ("ss", 0, -2), ("tt", 0, 2)))
    more = " ".join(f"JOIN {n} {n} ON {n}.level = m0.level AND {n}.cx = m0.cx AND {n}.cy = m0.cy" for n in ("ww", "ee", "ss", "tt"))
    gx, gy = "((ww.v - ee.v) + 8 * (e.v - w.v)) / 12", "((ss.v - tt.v) + 8 * (t.v - s.v)) / 12"
    normal = f"CASE WHEN sqrt(pow({gx}, 2) + pow({gy}, 2)) < 1e-13 THEN 1 ELSE sqrt(pow({gx}, 2) + pow({gy}, 2)) END"
    on_mixed("d_normal", lambda lv, c: placed(D.interface_normal(c, lv, CFG, "q"), r6("nx").alias("nx"), r6("ny").alias("ny")), f", {four} {joined(S6(f'({gx}) / ({normal})') + ' AS nx, ' + S6(f'({gy}) / ({normal})') + ' AS ny')} {more}")
    given = lambda c: c.withColumns({"nx": F.col("q") % 5 - 2.0, "ny": F.col("q") % 3 - 1.0})
    with_n = ", mn AS (SELECT level, cx, cy, q % 5 - 2.0 AS a, q % 3 - 1.0 AS b FROM m), " + ", ".join(near(n, dx, dy, "mn", v) for n, dx, dy, v in (("w", -1, 0, "a"), ("e", 1, 0, "a"), ("s", 0, -1, "b"), ("t", 0, 1, "b")))
    on_mixed("d_curvature", lambda lv, c: placed(D.curvature(given(c), lv, CFG), r6("curvature").alias("curvature")), f"{with_n} {joined(S6(f'-((e.v - w.v) + (t.v - s.v)) / {DX} * 0.5') + ' AS curvature', 'mn')}")
    phi = lambda c: c.select("key", "i", "j", ((F.col("q") % 9 + 1) / 10.0).alias("phi"), F.col("q").alias("curvature"))
    w = "pow((q % 9 + 1) / 10.0, 2) * pow(1 - (q % 9 + 1) / 10.0, 2)"
    ring = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    filt = f", fw AS (SELECT level, cx, cy, {w} AS w, {w} * q AS wk, q FROM m), " + ", ".join(near(f"{v}{k}", a, b, "fw", v) for k, (a, b) in enumerate(ring) for v in ("w", "wk"))
    ons = " ".join(f"JOIN {v}{k} {v}{k} ON {v}{k}.level = m0.level AND {v}{k}.cx = m0.cx AND {v}{k}.cy = m0.cy" for k in range(8) for v in ("w", "wk"))
    ratio = f"(m0.wk + {' + '.join(f'wk{k}.v' for k in range(8))}) / (m0.w + {' + '.join(f'w{k}.v' for k in range(8))})"
    on_mixed("d_curv_filtered", lambda lv, c: placed(D.filtered_curvature(phi(c), lv, CFG), r6("curvature").alias("curvature")), f"{filt} SELECT m0.level, m0.cx, m0.cy, {S6(f'CASE WHEN m0.w > 1e-6 THEN {ratio} ELSE m0.q END')} AS curvature FROM fw m0 {ons}")
    for points in (3, 5, 7):
        n, half = 8, points // 2
        cases = []
        for p in range(n):
            place = p if p < half else points - (n - p) if p >= n - half else half
            terms = " + ".join(f"({x!r}) * (a[{p + off + 1}] - a[{p + 1}])" for off, x in D.one_sided(points, place).items())
            cases.append(f"WHEN {p} THEN {terms}")
        sql = f", w AS (SELECT gx // 8 AS bx, gy, list(q ORDER BY gx) AS a FROM l GROUP BY 1, 2) SELECT 3 AS level, bx * 8 + p.range AS cx, gy AS cy, {S6('(CASE p.range ' + ' '.join(cases) + ' END) * 64.0')} AS d FROM w, range(8) p"
        reg.add(f"d_deriv_{points}", lambda spark, d, k=points: placed(D.derivative(cells_of(lattice(spark, d), WIDE, 3), WIDE, "q", 0, k), r6("derivative").alias("d"), block=8), f"WITH {LATTICE}{sql}")
    spots = lambda: F.explode(F.sequence(F.lit(0), F.lit(4)))
    edges = lambda c: c.select("key").distinct().select("key", spots().alias("i")).select("key", "i", spots().alias("j")).withColumn("v", ((F.col("i") * 3 + F.col("j") * 5 + K.morton_octant(F.col("key")) % 7) % 11).cast("double"))
    mo = "list_reduce([(((lx >> i) & 1) << (2 * i)) | (((ly >> i) & 1) << (2 * i + 1)) for i in range(4)], lambda x, y: x + y) * 68719476736"
    edge_sql = f", b AS (SELECT DISTINCT gx // 4 AS lx, gy // 4 AS ly FROM l), e0 AS (SELECT lx, ly, {mo} AS mo FROM b), ed AS (SELECT lx, ly, i.range AS i, j.range AS j, CAST((i.range * 3 + j.range * 5 + mo % 7) % 11 AS DOUBLE) AS v FROM e0, range(5) i, range(5) j)"
    on_base("d_curl", lambda c: placed(D.curl(edges(c), CFG), "dir", r6("v").alias("v")), f"{edge_sql} SELECT 4 AS level, a.lx * 4 + a.i AS cx, a.ly * 4 + a.j AS cy, 0 AS dir, {S6('(b.v - a.v) * 64')} AS v FROM ed a JOIN ed b ON a.lx = b.lx AND a.ly = b.ly AND a.i = b.i AND b.j = a.j + 1 UNION ALL SELECT 4, a.lx * 4 + a.i, a.ly * 4 + a.j, 1, {S6('(a.v - b.v) * 64')} FROM ed a JOIN ed b ON a.lx = b.lx AND a.ly = b.ly AND a.j = b.j AND b.i = a.i + 1")
    face = lambda c: edges(c).select("key", F.explode(F.array(F.struct(F.lit(0).alias("dir"), F.col("i"), F.col("j")), F.struct(F.lit(1).alias("dir"), F.col("i"), F.col("j")))).alias("f"), "v").select("key", "f.*", "v").filter("(dir = 0 and j < 4) or (dir = 1 and i < 4)")
    on_base("d_face_div", lambda c: placed(D.face_divergence(face(c), CFG), r6("divergence").alias("divergence")), f"{edge_sql}, w AS (SELECT *, lead(v) OVER (PARTITION BY lx, ly, j ORDER BY i) AS x, lead(v) OVER (PARTITION BY lx, ly, i ORDER BY j) AS y FROM ed) SELECT 4 AS level, lx * 4 + i AS cx, ly * 4 + j AS cy, {S6('(x - v + y - v) * 64')} AS divergence FROM w WHERE i < 4 AND j < 4")
    on_base("p_lincomb", lambda c: placed(D.combined(c, c.withColumn("q", F.col("n")), CFG, "q", 0.75, 0.25), r6("q").alias("q")), f" SELECT 4 AS level, gx AS cx, gy AS cy, {S6('0.75 * q + 0.25 * n')} AS q FROM l")
    state = lambda c: c.select("key", "i", "j", (F.col("n") + 1.0).alias("rho"), (F.col("q") + 10.0).alias("e_tot"), F.col("n").cast("double").alias("rho_vx"), (F.col("n") * 0.5).alias("rho_vy"))
    on_base("p_velocity", lambda c: placed(D.with_velocity(state(c), F.lit(0.5), F.lit(-0.25)), *[r6(x).alias(x) for x in ("e_tot", "rho_vx", "rho_vy")]), f" SELECT 4 AS level, gx AS cx, gy AS cy, {S6('q + 10.0 + (n + 1) * 0.3125 * 0.5 - (n * n + n * n * 0.25) / (n + 1) * 0.5')} AS e_tot, {S6('(n + 1) * 0.5')} AS rho_vx, {S6('(n + 1) * -0.25')} AS rho_vy FROM l")
    on_mixed("p_slice", lambda lv, c: A.line_slice(c, CFG, ["q"], 0, A.middle_line(CFG)).select(r6("position").alias("position"), "level", r6("q").alias("q")), f" SELECT {S6('(cx + 0.5) / (4 * pow(2, level))')} AS position, level, {S6('q')} AS q FROM m WHERE abs((cy + 0.5) / (4 * pow(2, level)) - 0.50001) < 0.5 / (4 * pow(2, level))")

    # Remapping and halos
    finer = lambda c: M.refine(c.select("key").distinct().withColumn("flag", F.lit(1)), CFG).select("key")
    remap = lambda c, kind: placed(R.remapped(finer(c), c, c.select("key").distinct(), CFG, ["q"], kind), r6("q").alias("q"))
    lm = ", m AS (SELECT 4 AS level, gx AS cx, gy AS cy, CAST(q AS DOUBLE) AS q FROM l)"
    on_base("r_copy", lambda c: remap(c, "simple_copy"), f" SELECT 5 AS level, 2 * gx + a.range AS cx, 2 * gy + c.range AS cy, {S6('q')} AS q FROM l, range(2) a, range(2) c")
    mm = lambda a, b: f"(CASE WHEN (m0.q - {a}.v) * ({b}.v - m0.q) <= 0 THEN 0 ELSE sign({b}.v - {a}.v) * least(abs(m0.q - {a}.v), abs({b}.v - m0.q), abs({b}.v - {a}.v) * 0.5) END)"
    on_base("r_linear_minmod", lambda c: remap(c, "linear_minmod"), f"{lm}, {sides()}, g AS ({joined(f'm0.q AS q, 0.25 * {mm('w', 'e')} AS x, 0.25 * {mm('s', 't')} AS y')}) SELECT 5 AS level, 2 * cx + a.range AS cx, 2 * cy + c.range AS cy, {S6('q + (2 * a.range - 1) * x + (2 * c.range - 1) * y')} AS q FROM g, range(2) a, range(2) c")
    for kind, left in (("order_2", {-1: "1.0 / 8", 0: "1.0", 1: "-1.0 / 8"}), ("order_4", {-2: "-3.0 / 128", -1: "11.0 / 64", 0: "1.0", 1: "-11.0 / 64", 2: "3.0 / 128"})):
        weights = "w AS (SELECT * FROM (VALUES " + ", ".join(f"(0, {s}, {x}), (1, {-s}, {x})" for s, x in left.items()) + ") v(half, step, x))"
        # one axis after the other over the periodic lattice
        on_base(f"r_{kind}", lambda c, k=kind: remap(c, k), f", {weights}, a1 AS (SELECT (gx - step + 64) % 64 AS cx, gy, half AS hx, sum(CAST(q AS DOUBLE) * x) AS v FROM l, w GROUP BY 1, 2, 3), a2 AS (SELECT cx, hx, (gy - step + 64) % 64 AS cy, half AS hy, sum(v * x) AS v FROM a1, w GROUP BY 1, 2, 3, 4) SELECT 5 AS level, 2 * cx + hx AS cx, 2 * cy + hy AS cy, {S6('v')} AS q FROM a2")
    reg.add("r_restrict", lambda spark, d: (lambda lv, c: placed(R.remapped(M.uniform(spark, CFG, 4), c, lv, CFG, ["q"]), r6("q").alias("q")))(*mixed(spark, d)), f"WITH {MIXED} SELECT 4 AS level, cx, cy, {S6('q')} AS q FROM m WHERE level = 4 UNION ALL SELECT 4, cx // 2, cy // 2, {S6('avg(q)')} FROM m WHERE level = 5 GROUP BY 2, 3")
    masks = lambda c: c.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, cast(q % 50 as int))")).alias("mask"))
    reg.add("r_presence", lambda spark, d: placed_leaves(R.presence_remapped(M.uniform(spark, CFG, 3), masks(base(spark, d)), CFG), "mask"), f"WITH {LATTICE} SELECT 3 AS level, gx // 8 AS lx, gy // 8 AS ly, bit_or(CAST(1 AS BIGINT) << CAST(q % 50 AS BIGINT)) AS mask FROM l GROUP BY 2, 3")
    def halo(width: int) -> str:
        """Ghost places of each leaf."""
        n = 4 + 2 * width
        return f"g0 AS (SELECT level, lx, ly, CAST(i.range - {width} AS INTEGER) AS i, CAST(j.range - {width} AS INTEGER) AS j FROM leaves, range({n}) i, range({n}) j WHERE NOT (i.range BETWEEN {width} AND {width + 3} AND j.range BETWEEN {width} AND {width + 3}))"

    span = "(CAST(pow(2, level) AS BIGINT) * 4)"
    ghosts = f", {halo(1)}, g AS (SELECT *, (lx * 4 + i + {span}) % {span} AS tx, (ly * 4 + j + {span}) % {span} AS ty FROM g0), fine AS (SELECT level, cx // 2 AS hx, cy // 2 AS hy, avg(q) AS q FROM m GROUP BY 1, 2, 3)"
    on_mixed("h_ghost_cells", lambda lv, c: placed_leaves(H.filled(c, lv, CFG, 1, ["q"]).filter("is_ghost"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), r6("q").alias("q")), f"{ghosts} SELECT g.level, lx, ly, i, j, {S6('coalesce(a.q, b.q, c.q)')} AS q FROM g LEFT JOIN m a ON a.level = g.level AND a.cx = tx AND a.cy = ty LEFT JOIN m b ON b.level = g.level - 1 AND b.cx = tx // 2 AND b.cy = ty // 2 LEFT JOIN fine c ON c.level = g.level + 1 AND c.hx = tx AND c.hy = ty")
    walled = lambda lv, c: H.filled(c, lv, CLOSED, 2, ["q"], {0: "wall"}, {0: "q"}).filter("is_ghost")
    inside = "lx * 4 + i BETWEEN 0 AND 63 AND ly * 4 + j BETWEEN 0 AND 63"
    source = f"leaves AS (SELECT DISTINCT 4 AS level, gx // 4 AS lx, gy // 4 AS ly FROM l), {halo(2)}, g AS (SELECT *, CASE WHEN {inside} THEN lx * 4 + i WHEN lx * 4 + i < 0 THEN -1 - i ELSE lx * 4 + least(greatest(i, 0), 3) END AS tx, CASE WHEN {inside} THEN ly * 4 + j ELSE ly * 4 + least(greatest(j, 0), 3) END AS ty FROM g0)"
    on_base("h_bc_wall", lambda c: placed_leaves(walled(c.select("key").distinct(), c.select("key", "i", "j", "q")), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), r6("q").alias("q")), f", {source} SELECT g.level, g.lx, g.ly, i, j, {S6('CASE WHEN g.lx * 4 + i < 0 THEN -q ELSE q END')} AS q FROM g JOIN l ON gx = tx AND gy = ty")
