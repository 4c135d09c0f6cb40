import math

from pyspark.sql import functions as F

from stratamesh.functions import keys as K
from stratamesh.functions import vof as V
from stratamesh.functions.algebra import SparkProgram
from stratamesh.functions.geometry import tangent
from stratamesh.operators import fields as D
from stratamesh.operators import mesh as M
from stratamesh.operators import remap as R
from stratamesh.plans.cuts import cut
from stratamesh.sources import snapshot
from stratamesh.sources.config import Settings, mesh_config
from stratamesh.streaming.loop import OutputPolicy, run

CFG = M.Config(block=(4, 4), level_max=5)


def corner_refined(spark, cfg=CFG, deepest=4):
    leaves = M.uniform(spark, cfg, 1)
    for level in range(1, deepest):
        x, y = K.octant_coords(F.col("key"))
        leaves = cut(M.refine(leaves.select("key", ((x == 0) & (y == 0) & (K.level(F.col("key")) == level)).cast("int").alias("flag")), cfg).select("key"))
    return leaves


def area(leaves):
    return leaves.agg(F.sum(F.pow(F.lit(4.0), -K.level(F.col("key"))))).first()[0]


def test_balance_keeps_area_and_settles(spark):
    leaves = corner_refined(spark)
    assert not M.is_balanced(leaves, CFG)
    done = M.balance(leaves, CFG)
    assert M.is_balanced(done, CFG) and area(done) == 1.0


def test_refine_then_coarsen_is_identity(spark):
    start = M.uniform(spark, CFG, 2)
    fine = M.refine(start.withColumn("flag", F.lit(1)), CFG).select("key")
    back = M.coarsen(fine.withColumn("flag", F.lit(-1)), CFG).select("key")
    assert sorted(r.key for r in back.collect()) == sorted(r.key for r in start.collect())
    fresh = M.coarsen(M.refine(start.withColumn("flag", F.lit(1)), CFG), CFG)
    assert fresh.count() == 64  # new children never merge in the same cycle


def test_prolongations_conserve_and_restrict_back(spark):
    old = M.uniform(spark, CFG, 2)
    cells = R.lattice(old, CFG).withColumn("q", (F.col("i") * 7 + F.col("j") * 3 + K.morton_octant(F.col("key")) % 13).cast("double"))
    new = M.refine(old.withColumn("flag", F.lit(1)), CFG).select("key")
    total = cells.agg(F.sum("q")).first()[0]
    for kind in ("simple_copy", "linear_minmod", "order_2", "order_4"):
        fine = R.remapped(new, cells, old, CFG, ["q"], kind)
        assert math.isclose(fine.agg(F.sum("q")).first()[0], 4 * total, rel_tol=1e-12), kind
    back = R.remapped(old, R.remapped(new, cells, old, CFG, ["q"]), new, CFG, ["q"])
    assert back.withColumnRenamed("q", "p").join(cells, ["key", "i", "j"]).filter(F.abs(F.col("p") - F.col("q")) > 1e-12).isEmpty()


def test_derivative_is_exact_on_quadratics(spark):
    cfg = M.Config(block=(8, 8))
    cells = R.lattice(M.uniform(spark, cfg, 0), cfg).withColumn("q", F.pow((F.col("i") + 0.5) / 8, 2))
    for points in (3, 5, 7):
        d = D.derivative(cells, cfg, "q", 0, points)
        assert d.filter(F.abs(F.col("derivative") - 2 * (F.col("i") + 0.5) / 8) > 1e-12).isEmpty()


def test_goldens_of_geometry(spark):
    P = SparkProgram(spark.createDataFrame([(0.5,)], "p double"))
    (nx, ny), alpha = tangent([F.col("p"), F.col("p")], [F.lit(0.0), F.lit(0.0)], 1.0)
    row = P.select(nx=nx, ny=ny, alpha=alpha).first()
    assert all(math.isclose(a, b, abs_tol=1e-14) for a, b in zip(row, (math.sqrt(0.5), math.sqrt(0.5), 1.0), strict=True))
    diagonal = [1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    P = SparkProgram(spark.createDataFrame([tuple(diagonal)], ", ".join(f"f{i} double" for i in range(9))))
    n = V.youngs(P, [F.col(f"f{i}") for i in range(9)], (1.0, 1.0))
    row = P.select(x=n[0], y=n[1]).first()
    assert (row.x, row.y) == (0.0, 1.0)
    P = SparkProgram(spark.createDataFrame([(1.0, 2.0, 0.0)], "nx double, ny double, al double"))
    assert P.select(a=V.area_below(P, [F.col("nx"), F.col("ny")], F.col("al"))).first().a == 0.5


def test_snapshot_round_trip_and_config(spark, tmp_path):
    settings = Settings("[Mesh]\nDim=2\nnbrick_x = 3 ; trees\nperiodic_x=false\nbx=4\nby=4\n[amr]\nlevel_max=5\n")
    cfg = mesh_config(settings)
    assert cfg.brick == (3, 1) and cfg.periodic == (False, True) and cfg.level_max == 5
    leaves = M.uniform(spark, cfg, 1)
    cells = R.lattice(leaves, cfg).withColumn("rho", F.lit(1.5))
    path = f"{tmp_path}/snap"
    snapshot.write(path, leaves, cells, cfg, scalars={"time": 0.25})
    assert snapshot.config(spark, path) == cfg and snapshot.attributes(spark, path)["time"] == 0.25
    assert snapshot.cells(spark, path, ["rho"], max_level=1).count() == 12 * 16
    assert snapshot.cells(spark, path, ["rho"], max_level=0).isEmpty()


def test_time_loop(spark):
    saved = []
    state, now, n = run(spark.createDataFrame([(1.0,)], "v double"), lambda s, dt: s.withColumn("v", F.col("v") * (1 - dt)), lambda s: 0.1, 0.25, OutputPolicy(interval=0.1), lambda s, t, i: saved.append(round(t, 3)))
    assert n == 3 and math.isclose(now, 0.25) and math.isclose(state.first().v, 0.9 * 0.9 * 0.95) and saved == [0.0, 0.1, 0.2]
