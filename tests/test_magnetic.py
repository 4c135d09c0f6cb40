"""Magnetic solvers against what any of them must give: the flux of equal states, upwinding, mirror images, known limits."""

import random

import pytest
from pyspark.sql import functions as F

from stratamesh.functions import flux, magnetic
from stratamesh.functions.algebra import SparkProgram

NAMES = ("r", "u", "v", "w", "p", "bx", "by", "bz")
GAMMA = 1.4


def states(n, seed, speed=1.0):
    rng = random.Random(seed)
    return [[rng.uniform(0.2, 2.0), rng.uniform(-speed, speed), rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0.2, 2.0), *[rng.uniform(-1, 1) for _ in range(3)]] for _ in range(n)]


def exact(q):
    """The flux in plain Python."""
    r, u, v, w, p, a, b, c = q
    m = (a * a + b * b + c * c) / 2
    e = p / (GAMMA - 1) + r * (u * u + v * v + w * w) / 2 + m
    return {"r": r * u, "e": (e + p + m) * u - a * (u * a + v * b + w * c), "u": r * u * u + p + m - a * a, "v": r * u * v - a * b, "w": r * u * w - a * c, "bx": 0.0, "by": b * u - a * v, "bz": c * u - a * w}


def solved(spark, kind, pairs, **options):
    df = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(pairs)], ["i", *[f"{n}1" for n in NAMES], *[f"{n}2" for n in NAMES]])
    P = SparkProgram(df)
    out = magnetic.solve_mhd(kind, P, *({n: F.col(f"{n}{s}") for n in NAMES} for s in (1, 2)), **options)
    return [r.asDict() for r in P.select(i=F.col("i"), **out).orderBy("i").collect()]


def near(found, expected):
    assert {k: found[k] for k in expected} == pytest.approx(expected, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("kind", [k for k in magnetic.MHD_SOLVERS if k not in ("hllc", "hlld_boris")])
def test_equal_states_give_their_flux(spark, kind):
    qs = states(40, 1)
    for q, found in zip(qs, solved(spark, kind, [(q, q) for q in qs]), strict=True):
        near(found, exact(q))


def test_boris_without_a_bound_on_speeds_is_hlld(spark):
    pairs = list(zip(states(60, 2), states(60, 3), strict=True))
    for found, expected in zip(solved(spark, "hlld_boris", pairs, limit=1e7), solved(spark, "hlld", pairs), strict=True):
        assert {k: found[k] for k in expected} == pytest.approx(expected, rel=1e-6, abs=1e-6)


def test_boris_slows_the_flux_of_equal_states(spark):
    """The velocity of each state is taken times its factor."""
    qs = states(40, 4)
    for q, found in zip(qs, solved(spark, "hlld_boris", [(q, q) for q in qs], limit=1.0), strict=True):
        r, u = q[0], q[1]
        factor = 1 / (1 + sum(b * b for b in q[5:]) / r)
        assert found["r"] == pytest.approx(r * u * factor, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("kind", [k for k in magnetic.MHD_SOLVERS if k != "llf"])
def test_fast_flows_are_upwind(spark, kind):
    left, right = states(20, 5), states(20, 6)
    for q in left + right:
        q[1], q[5], q[6], q[7] = 60.0, 0.3, *((q[6], q[7]) if kind != "hllc" else (0.0, 0.0))
    for q, found in zip(left, solved(spark, kind, list(zip(left, right, strict=True)), **({"limit": 1e7} if kind == "hlld_boris" else {})), strict=True):
        if kind.startswith("five"):
            assert found["r"] == pytest.approx(q[0] * 60, rel=0.5)  # moves with the speed between the states
        elif kind == "hllc":
            near(found, {k: v for k, v in exact([*q[:5], 0.0, 0.0, 0.0]).items() if k[0] != "b"})
        else:
            assert {k: found[k] for k in NAMES if k != "p"} == pytest.approx({k: v for k, v in exact(q).items() if k != "e"}, rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("kind", list(magnetic.MHD_SOLVERS))
def test_mirror_images(spark, kind):
    pairs = list(zip(states(60, 7), states(60, 8), strict=True))
    turn = lambda q: [q[0], -q[1], *q[2:5], -q[5], *q[6:]]
    for a, b in zip(solved(spark, kind, pairs), solved(spark, kind, [(turn(y), turn(x)) for x, y in pairs]), strict=True):
        near(a, {k: b[k] if k in ("u", "bx") else -b[k] for k in ("r", "e", "u", "v", "w", "by", "bz")})


@pytest.mark.parametrize("kind", list(magnetic.MHD_SOLVERS))
def test_no_field_at_all(spark, kind):
    """Neither a missing normal field nor a missing field divides by zero."""
    pairs = [([1.0, 0.2, 0.1, 0.0, 1.0, 0.0, 0.0, 0.0], [0.125, 0.0, 0.0, 0.3, 0.1, 0.0, 0.0, 0.0]), ([1.0, 0.0, 0.1, 0.0, 1.0, 0.0, 0.5, 0.0], [1.0, 0.0, 0.0, 0.3, 1.0, 0.0, -0.5, 0.2])]
    found = solved(spark, kind, pairs)
    assert all(v is not None and abs(v) < 10 for row in found for v in row.values())
    assert found[0]["by"] == found[0]["bz"] == 0 and found[0]["r"] > 0


def test_strong_fields_drop_the_stretching(spark):
    calm, strong = [1.0, 0.1, 0.0, 0.0, 1.0, 0.5, 0.2, 0.0], [1.0, 0.1, 0.0, 0.0, 1e-6, 0.5, 0.2, 0.0]
    plain, other = solved(spark, "five_waves", [(calm, calm), (strong, strong)]), solved(spark, "five_waves_entropy", [(calm, calm), (strong, strong)])
    near(other[0], {k: plain[0][k] for k in ("by", "bx", "e")})
    assert other[1]["bx"] == pytest.approx(0.05) and other[1]["by"] == pytest.approx(0.02) and plain[1]["bx"] == pytest.approx(0.0)


def emfs(spark, corners, axis=2):
    df = spark.createDataFrame([(i, *[float(x) for q in four for x in q]) for i, four in enumerate(corners)], ["i", *[f"{n}{k}" for k in range(4) for n in NAMES]])
    P = SparkProgram(df)
    value = magnetic.edge_emf_hlld(P, magnetic.edge_states([{n: F.col(f"{n}{k}") for n in NAMES} for k in range(4)], axis))
    return [r.emf for r in P.select(i=F.col("i"), emf=value).orderBy("i").collect()]


def test_emf_of_equal_states_upwind_corners_and_turned_axes(spark):
    qs = states(30, 9)
    for axis in range(3):
        a, b = (axis + 1) % 3, (axis + 2) % 3
        assert emfs(spark, [[q] * 4 for q in qs], axis) == pytest.approx([q[1 + a] * q[5 + b] - q[1 + b] * q[5 + a] for q in qs], abs=1e-9)
    fast = [[*q] for q in states(4, 10)]
    for q in fast:
        q[1], q[2], q[5], q[6] = 50.0, 50.0, 0.4, 0.3
    assert emfs(spark, [fast])[0] == pytest.approx(fast[0][1] * 0.3 - fast[0][2] * 0.4)


def test_emf_is_odd_under_exchange_of_axes(spark):
    fours = [states(4, 20 + i, 2.0) for i in range(30)]
    turn = lambda q: [q[0], q[2], q[1], q[3], q[4], q[6], q[5], q[7]]
    swapped = [[turn(f[0]), turn(f[2]), turn(f[1]), turn(f[3])] for f in fours]
    assert emfs(spark, fours) == pytest.approx([-e for e in emfs(spark, swapped)], rel=1e-9, abs=1e-9)


def test_schedules():
    assert flux.sweeps("none", 3, 7) == [0, 1, 2]
    assert [flux.sweeps("permutation", 3, i) for i in range(7)] == [[0, 1, 2], [2, 1, 0], [1, 2, 0], [0, 2, 1], [2, 0, 1], [1, 0, 2], [0, 1, 2]]
    assert [len(p) for p in flux.schedule("ruth_order3", 2)] == [6, 6] and [len(p) for p in flux.schedule("ruth_order3", 3)] == [21] * 6
    for dim in (2, 3):
        for phase in flux.schedule("ruth_order3", dim):
            shares = [sum(w for d, w in phase if d == axis) for axis in range(dim)]
            assert shares == pytest.approx([1.0] * dim)
