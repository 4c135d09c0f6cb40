"""Face fields: values on the faces between cells (key, dir, axes, v), where faces along ``dir`` count one more along it than cells.

Lookup goes as for cells, by one join with the leaves under their own, their children's and their father's keys. A face of a finer neighbour is the nearer one,
or the mean of the 2^(dim-1) faces that make up the face.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from .aggregates import line_slice
from .mesh import Config
from .neighbors import COARSER, FINER, NONE, OUTSIDE, OWN, leaf_neighbors


def face_cells(leaves: DataFrame, cfg: Config) -> DataFrame:
    """(key, dir, axes) of all faces of each leaf."""
    spots = [(d, s) for d in range(cfg.dim) for s in product(*[range(n + (k == d)) for k, n in enumerate(cfg.block)])]
    every = F.array(*[F.struct(F.lit(d).alias("dir"), *[F.lit(c).alias(a) for a, c in zip(cfg.axes, s, strict=True)]) for d, s in spots])
    return leaves.select("key", F.explode(every).alias("p")).select("key", "p.*")


def _longer(d: int) -> Column:
    return (F.col("dir") == d).cast("int")


def located_faces(probes: DataFrame, leaves: DataFrame, cfg: Config) -> DataFrame:
    """Adds at (leaf), t<axis> and status to probes with key, dir and axes that may lie outside the block; beyond the domain: the nearest face of the own block."""
    names = [f"d{a}" for a in "xyz"[: cfg.dim]]
    rows, inside = probes, F.lit(True)
    for d, (a, n) in enumerate(zip(cfg.axes, cfg.block, strict=True)):
        rows = rows.withColumn(f"_{names[d]}", F.when(F.col(a) < 0, -1).when(F.col(a) >= n + _longer(d), 1).otherwise(0).cast("int"))
        inside = inside & (F.col(f"_{names[d]}") == 0)
    around = leaf_neighbors(leaves, cfg).select("key", *[F.col(n).alias(f"_{n}") for n in names], F.col("target").alias("_target"), F.col("status").alias("_status"), F.col("leaf").alias("_leaf"))
    own = rows.filter(inside).withColumns({"_target": F.col("key"), "_status": F.lit(OWN), "_leaf": F.col("key")})
    out = rows.filter(~inside).join(around, ["key", *[f"_{n}" for n in names]], "left").withColumn("_status", F.coalesce("_status", F.lit(NONE)))
    rows = own.unionByName(out.select(own.columns))
    coarse, fine, lost = F.col("_status") == COARSER, F.col("_status") == FINER, F.col("_status").isin(OUTSIDE, NONE)
    target, child = {}, F.lit(0)
    for d, (a, n) in enumerate(zip(cfg.axes, cfg.block, strict=True)):
        wrapped = F.col(a) - n * F.col(f"_{names[d]}")
        bit = K.child_id(F.col("_target"), cfg.dim).bitwiseAND(F.lit(1 << d)) != 0
        half = F.call_function("div", wrapped + F.when(bit, n + _longer(d)).otherwise(0), F.lit(2))
        twice = wrapped * 2 - F.when(wrapped * 2 >= n, n).otherwise(0)
        nearest = F.least(F.greatest(F.col(a), F.lit(0)), n - 1 + _longer(d))
        target[f"t{a}"] = F.when(lost, nearest).when(coarse, half).when(fine, twice).otherwise(wrapped).cast("int")
        child = child + F.when(wrapped * 2 >= n, 1 << d).otherwise(0)
    at = F.when(lost, F.col("key")).when(fine, K.child(F.col("_target"), child, cfg.dim)).otherwise(F.col("_leaf"))
    return rows.withColumns({"at": at, "status": F.col("_status")} | target).drop("_target", "_status", "_leaf", *[f"_{n}" for n in names])


def face_neighbors(faces: DataFrame, leaves: DataFrame, cfg: Config, shift: tuple[int, ...]) -> DataFrame:
    """(key, dir, axes, at, t<axis>, status): where the face one shift away is."""
    origin = [f"_{a}" for a in cfg.axes]
    moved = faces.select("key", "dir", *[F.col(a).alias(o) for a, o in zip(cfg.axes, origin, strict=True)], *[(F.col(a) + s).cast("int").alias(a) for a, s in zip(cfg.axes, shift, strict=True)])
    return located_faces(moved, leaves, cfg).select("key", "dir", *[F.col(o).alias(a) for a, o in zip(cfg.axes, origin, strict=True)], "at", *[f"t{a}" for a in cfg.axes], "status")


def flux_halo(fluxes: DataFrame, leaves: DataFrame, cfg: Config, axis: int) -> DataFrame:
    """The ghost fluxes one step before and behind each block along an axis: (key, axes, v).

    A copy at the same level, the coarse flux from a coarser leaf, the mean over the parts of the face from finer ones, the block's own border flux beyond the domain.
    """
    own = fluxes.filter(F.col("dir") == axis)
    across = [k for k in range(cfg.dim) if k != axis]
    spots = [s for s in product(*[(-1, n + 1) if k == axis else range(n) for k, n in enumerate(cfg.block)])]
    every = F.array(*[F.struct(*[F.lit(c).alias(a) for a, c in zip(cfg.axes, s, strict=True)]) for s in spots])
    probes = leaves.select("key", F.lit(axis).alias("dir"), F.explode(every).alias("p")).select("key", "dir", "p.*")
    places = located_faces(probes, leaves, cfg).withColumn("parts", (F.col("status") == FINER).cast("int"))
    single = own.select(F.col("key").alias("at"), F.lit(0).alias("parts"), *[F.col(a).cast("int").alias(f"t{a}") for a in cfg.axes], F.col("v").cast("double").alias("v"))
    pair = [(F.col(a) - (F.col(a) % 2 if k in across else 0)).cast("int").alias(f"t{a}") for k, a in enumerate(cfg.axes)]
    means = own.groupBy(F.col("key").alias("at"), *pair).agg(F.avg("v").alias("v")).withColumn("parts", F.lit(1))
    found = places.join(single.unionByName(means.select(single.columns)), ["at", "parts", *[f"t{a}" for a in cfg.axes]], "left")
    return found.select("key", *cfg.axes, "v")


def to_cells(faces: DataFrame, cfg: Config) -> DataFrame:
    """One row for each cell with the values on its lower and upper faces along each axis: l0, r0, l1, r1 ..., in one aggregation."""
    ends = []
    for d, a in enumerate(cfg.axes):
        mine = F.col("dir") == d
        cell = lambda step, a=a: [(F.col(x) - (step if x == a else 0)).cast("int").alias(x) for x in cfg.axes]
        ends.append(F.when(mine & (F.col(a) < cfg.block[d]), F.struct(*cell(0), F.lit(2 * d).alias("side"), F.col("v").alias("v"))))
        ends.append(F.when(mine & (F.col(a) > 0), F.struct(*cell(1), F.lit(2 * d + 1).alias("side"), F.col("v").alias("v"))))
    rows = faces.select("key", F.explode(F.filter(F.array(*ends), lambda x: x.isNotNull())).alias("e")).select("key", "e.*")
    return rows.groupBy("key", *cfg.axes).agg(*[F.max(F.when(F.col("side") == 2 * d + s, F.col("v"))).alias(f"{n}{d}") for d in range(cfg.dim) for s, n in enumerate("lr")])


def face_slice(faces: DataFrame, cfg: Config, component: int, axis: int, at: tuple[float, ...], begin: float = 0.0, end: float = 1.0) -> DataFrame:
    """Along a line: the mean of the two faces of each cell along ``component``."""
    mean = to_cells(faces, cfg).withColumn("v", (F.col(f"l{component}") + F.col(f"r{component}")) / 2)
    return line_slice(mean, cfg, ["v"], axis, at, begin, end)


def discontinuous(faces: DataFrame, leaves: DataFrame, cfg: Config, tolerance: float = 1e-12) -> DataFrame:
    """Faces on block borders whose neighbour of the same level holds another value: (key, dir, axes, v, other); empty if the field is continuous."""
    out = None
    for d, (a, n) in enumerate(zip(cfg.axes, cfg.block, strict=True)):
        step = [0] * cfg.dim
        step[d] = 1
        near = leaf_neighbors(leaves, cfg, [tuple(step)]).filter("status = 0").select("key", "leaf")
        upper = faces.filter((F.col("dir") == d) & (F.col(a) == n)).join(near, "key")
        lower = faces.filter((F.col("dir") == d) & (F.col(a) == 0)).select(F.col("key").alias("leaf"), *[F.col(x) for x in cfg.axes if x != a], F.col("v").alias("other"))
        both = upper.join(lower, ["leaf", *[x for x in cfg.axes if x != a]]).filter(F.abs(F.col("v") - F.col("other")) > tolerance).select("key", "dir", *cfg.axes, "v", "other")
        out = both if out is None else out.unionByName(both)
    return out
