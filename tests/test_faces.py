"""Face operators, block indices, borders and remapping against numbers worked out by hand or in plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from stratamesh.functions import blocks as B
from stratamesh.functions import keys as K
from stratamesh.functions import vof as V
from stratamesh.functions.algebra import Sql, SqlProgram
from stratamesh.operators import halo as H
from stratamesh.operators import mesh as M
from stratamesh.operators import remap as R
from stratamesh.sources.config import Settings, borders, gravity, mesh_config

duckdb = pytest.importorskip("duckdb")


def test_surface_places_are_the_cells_of_each_face_in_order():
    for block in ((4, 6), (4, 6, 2)):
        expected = []
        for d in range(len(block)):
            for side in (0, 1):
                for rest in itertools.product(*[range(n) for n in reversed([n for k, n in enumerate(block) if k != d])]):
                    at = list(reversed(rest))
                    at.insert(d, side * (block[d] - 1))
                    expected.append((*at, 2 * d + side, *[(2 * side - 1) * (k == d) for k in range(len(block))]))
        assert len(expected) == B.surface_cells(block)
        P = SqlProgram(f"(SELECT range AS f FROM range({len(expected)}))")
        coords, face, normal = B.surface_place(P, P.col("f"), block)
        sql = P.select(f=Sql("f"), **{f"c{i}": c for i, c in enumerate(coords)}, face=face, **{f"n{i}": n for i, n in enumerate(normal)})
        assert [r[1:] for r in duckdb.sql(sql + " ORDER BY f").fetchall()] == expected


def test_face_places():
    P = SqlProgram("(SELECT range AS f FROM range(38))")
    coords, axis = B.face_place(P, P.col("f"), (3, 5))
    got = [r[1:] for r in duckdb.sql(P.select(f=Sql("f"), i=coords[0], j=coords[1], axis=axis) + " ORDER BY f").fetchall()]
    assert got == [(i, j, 0) for j in range(5) for i in range(4)] + [(i, j, 1) for j in range(6) for i in range(3)]


def test_arg_min_takes_the_first_of_equal_values():
    P = SqlProgram("(SELECT * FROM (VALUES (1.0, 1.0, 0.5), (2.0, 1.0, 1.0), (0.0, 0.0, 0.0)) v(a, b, c))")
    got = duckdb.sql(P.select(m=B.arg_min(P, P.col("a"), P.col("b"), P.col("c")))).fetchall()
    assert sorted(r[0] for r in got) == [0, 1, 2]


def test_planes_cut_off_the_wanted_volume():
    r = random.Random(3)
    rows = [tuple(r.choice((0.0, r.uniform(-1, 1))) for _ in range(2)) + (r.uniform(0.1, 1), r.uniform(0.001, 0.999)) for _ in range(3000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE d (a DOUBLE, b DOUBLE, c DOUBLE, v DOUBLE)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?, ?)", rows)
    P = SqlProgram("d")
    n = [P.col(x) for x in "abc"]
    sql = P.select(back=V.volume_below(P, n, V.plane_for_volume(P, n, P.col("v"))), v=Sql("v"))
    assert max(abs(a - b) for a, b in con.sql(sql).fetchall()) < 1e-9
    # a plane through a corner tetrahedron: x + y + z = 1 in the unit cube cuts off 1/6
    P = SqlProgram("(SELECT 1.0::DOUBLE AS one, 1.0::DOUBLE / 6 AS v)")
    one = [P.col("one")] * 3
    assert abs(con.sql(P.select(a=V.plane_for_volume(P, one, P.col("v")))).fetchall()[0][0] + 0.5) < 1e-12


def test_brick_numbers():
    assert M.brick_trees((3, 2)) == [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (2, 1)]
    assert M.brick_trees((2, 2, 2)) == [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
    assert M.brick_trees((1, 3)) == [(0, 0), (0, 1), (0, 2)]


@pytest.mark.parametrize("kind", ["order_2", "order_4"])
@pytest.mark.parametrize("dim", [2, 3])
def test_interpolation_is_a_tensor_product(spark, kind, dim):
    """On a periodic uniform mesh: one axis after the other, in plain Python; the sum is conserved."""
    n, level = 4, 1
    cfg = M.Config(dim=dim, brick=(1,) * dim, periodic=(True,) * dim, block=(n,) * dim, level_min=0, level_max=3)
    leaves = M.uniform(spark, cfg, level)
    size, r = n << level, random.Random(dim)
    values = {at: r.randint(-9, 9) for at in itertools.product(range(size), repeat=dim)}
    left = {"order_2": {-1: 1 / 8, 0: 1.0, 1: -1 / 8}, "order_4": {-2: -3 / 128, -1: 11 / 64, 0: 1.0, 1: -11 / 64, 2: 3 / 128}}[kind]
    corner = lambda at: [c // n << K.LAYOUTS[dim].max_level - level for c in at]
    rows = [(*[c % n for c in at], *corner(at), float(v)) for at, v in values.items()]
    names = [*cfg.axes, *[f"o{a}" for a in cfg.axes], "q"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'double' if c == 'q' else 'long' if c[0] == 'o' else 'int'}" for c in names))
    cells = df.select(K.encode([F.lit(0).cast("long")] * dim, [F.col(f"o{a}") for a in cfg.axes], F.lit(level)).alias("key"), *cfg.axes, "q")
    new = M.uniform(spark, cfg, level + 1)
    got = {}
    out = R.remapped(new, cells, leaves, cfg, ["q"], kind).select(*[F.call_function("div", c, K.length(F.col("key"), dim)).alias(f"b{k}") for k, c in enumerate(K.octant_coords(F.col("key"), dim))], *cfg.axes, "q")
    for x in out.collect():
        got[tuple(x[f"b{k}"] * n + x[a] for k, a in enumerate(cfg.axes))] = x.q
    assert len(got) == (2 * size) ** dim and abs(sum(got.values()) - sum(values.values()) * 2**dim) < 1e-6
    for at in r.sample(sorted(got), 40):
        total = 0.0
        for steps in itertools.product(left, repeat=dim):
            w = 1.0
            for c, s in zip(at, steps, strict=True):
                w *= left[-s if c % 2 else s]
            total += w * values[tuple((c // 2 + s) % size for c, s in zip(at, steps, strict=True))]
        assert abs(got[at] - total) < 1e-9


def test_borders_of_a_configuration(spark):
    s = Settings("[mesh]\ndim=2\nboundary_type_xmin=WALL\nboundary_type_ymax=nonsense\n[gravity]\nuniform_gy=-9.81\n")
    assert borders(s, 2) == {0: "wall", 1: "periodic", 2: "periodic", 3: "none"} and mesh_config(s).periodic == (False, False)
    assert mesh_config(Settings()).periodic == (True, True) and gravity(s, 3) == (0.0, -9.81, 0.0)


def test_given_values_beyond_borders(spark):
    cfg = M.Config(dim=2, brick=(1, 1), periodic=(False, False), block=(2, 2), level_min=0, level_max=2)
    leaves = M.uniform(spark, cfg, 0)
    cells = R.lattice(leaves, cfg).withColumn("q", F.lit(7.0))
    out = H.filled(cells, leaves, cfg, 1, ["q"], {0: "analytical", 1: "none", 2: "wall"}, {1: "q"}, lambda at, name: at[0] * 100 + at[1]).filter("is_ghost")
    got = {(r.i, r.j): r.q for r in out.collect()}
    assert got[-1, 0] == -25 + 0.25 and got[2, 1] is None and got[0, -1] == -7.0 and got[1, 2] == 7.0
