"""Initial states at points worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from stratamesh.sources.config import Settings
from stratamesh.sources.problems import initial


def at(spark, name, points, given=""):
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], ["i", "x", "y", "z"])
    out = initial(name, Settings(given), [F.col(a) for a in "xyz"][: 1 if name in ("sod", "shu_osher", "woodward") else 2 if name == "rotor" else 3])
    return [r.asDict() for r in df.select("i", *[(v if not isinstance(v, float) else F.lit(v)).alias(k) for k, v in out.items()]).orderBy("i").collect()]


def test_tubes(spark):
    left, right = at(spark, "sod", [(0.49, 0, 0), (0.5, 0, 0)])
    assert (left["r"], left["p"], right["r"], right["p"]) == (1.0, 1.0, 0.125, 0.1)
    moved = at(spark, "sod", [(2.9, 0, 0), (3.1, 0, 0)], "[mesh]\nxmin = 1\nscaling_factor = 2\nnbrick_x = 2\n[sod]\npR = 0.3")
    assert [m["p"] for m in moved] == [1.0, 0.3]
    left, right = at(spark, "shu_osher", [(-4.1, 0, 0), (1.0, 0, 0)])
    assert left["u"] == pytest.approx(2.629369) and left["r"] == pytest.approx(3.857143) and right["r"] == pytest.approx(1 + 0.2 * math.sin(5.0))
    assert [q["p"] for q in at(spark, "woodward", [(0.05, 0, 0), (0.5, 0, 0), (0.95, 0, 0)])] == [1000.0, 0.01, 100.0]


def test_blast_and_rotor(spark):
    inside, outside = at(spark, "blast", [(0.5, 0.5, 0.54), (0.5, 0.5, 0.56)])
    assert (inside["r"], inside["p"], outside["r"], outside["p"], outside["by"]) == (1.0, 10.0, 1.2, 0.1, pytest.approx(math.sqrt(3)))
    middle, core, ring, rest = at(spark, "rotor", [(0.5, 0.5, 0), (0.55, 0.5, 0), (0.5, 0.6075, 0), (0.7, 0.5, 0)])
    assert (middle["u"], middle["v"], middle["r"]) == (0.0, 0.0, 10.0) and core["v"] == pytest.approx(1.0) and core["u"] == pytest.approx(0.0)
    assert ring["r"] == pytest.approx(5.5) and ring["u"] == pytest.approx(-1.0) and (rest["r"], rest["v"]) == (1.0, 0.0)
    with pytest.raises(ValueError, match="unknown problem"):
        initial("nothing", Settings(), [])
