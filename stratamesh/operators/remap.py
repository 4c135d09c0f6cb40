"""Carrying cell values from an old mesh to a new one: copy, prolongation, restriction."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.algebra import minmod
from .fields import with_neighbors, with_steps
from .mesh import Config
from .neighbors import COARSER, FINER, SAME, _build, fetched


def lattice(leaves: DataFrame, cfg: Config) -> DataFrame:
    """(key, axes): all cells of each leaf."""
    spots = F.array(*[F.struct(*[F.lit(c).alias(a) for a, c in zip(cfg.axes, s, strict=True)]) for s in product(*[range(n) for n in cfg.block])])
    return leaves.select("key", F.explode(spots).alias("p")).select("key", "p.*")


def matched(new: DataFrame, old: DataFrame, cfg: Config) -> DataFrame:
    """The new leaves' cells with their place in the old mesh: at, fine, t<axis>, relation (0 same, 1 the old leaf is coarser, 2 it is finer)."""
    build = _build(old, cfg)
    hit = (F.col("key") == F.col("at")) & ((F.col("status") != FINER) | (F.col("which") == 0))
    leaf = new.select("key").join(build, hit).select("key", "leaf", "status")
    cells = lattice(leaf.select("key"), cfg).join(leaf, "key")
    finer, coarser = F.col("status") == FINER, F.col("status") == COARSER
    out, bits = {}, F.lit(0)
    for d, (a, n) in enumerate(zip(cfg.axes, cfg.block, strict=True)):
        bit = K.child_id(F.col("key"), cfg.dim).bitwiseAND(F.lit(1 << d))
        half = F.call_function("div", F.col(a) + F.when(bit != 0, n).otherwise(0), F.lit(2))
        within = F.col(a) - F.when(F.col(a) * 2 >= n, n // 2).otherwise(0)
        out[f"t{a}"] = F.when(coarser, half).when(finer, within).otherwise(F.col(a)).cast("int")
        bits = bits + F.when(F.col(a) * 2 >= n, 1 << d).otherwise(0)
    at = F.when(finer, K.child(F.col("key"), bits, cfg.dim)).otherwise(F.col("leaf"))
    return cells.withColumns({"at": at, "fine": finer.cast("int")} | out).withColumnRenamed("status", "relation").drop("leaf")


def _sign(cfg: Config, axis: int) -> Column:
    """-1 or 1: which half of the coarse cell a new cell lies in."""
    return F.when(F.col(cfg.axes[axis]) % 2 == 0, -1.0).otherwise(1.0)


#: Weights of the cells from left to right for a new cell in the left half of the middle one; the right half has them mirrored.
INTERPOLATION = {"order_2": (1 / 8, 1.0, -1 / 8), "order_4": (-3 / 128, 11 / 64, 1.0, -11 / 64, 3 / 128)}


def remapped(new: DataFrame, cells: DataFrame, old: DataFrame, cfg: Config, names: list[str], prolongation: str = "simple_copy") -> DataFrame:
    """Cell values on the new leaves.

    Same leaves keep theirs, coarsened ones take means; refined ones take the coarse cell's value (simple_copy), or add a quarter of its limited slopes along each axis
    (linear_minmod), or interpolate along one axis after the other over 3 or 5 cells (order_2, order_4), which takes in the diagonal ones. All of them conserve the sum.
    """
    places = matched(new, old, cfg)
    if prolongation == "simple_copy":
        out = fetched(places, cells, cfg, names)
        return out.select("key", *cfg.axes, *[F.col(f"n_{n}").alias(n) for n in names])
    if prolongation == "linear_minmod":
        rich = with_neighbors(cells, old, cfg, names, 1)
        got = fetched(places, rich, cfg, [*names, *[f"{n}_{side}{d}1" for n in names for d in range(cfg.dim) for side in "lr"]])

        def value(n: str) -> Column:
            base = F.col(f"n_{n}")
            for d in range(cfg.dim):
                left, right = F.col(f"n_{n}_l{d}1"), F.col(f"n_{n}_r{d}1")
                slope = minmod(minmod(F.col(f"n_{n}") - left, right - F.col(f"n_{n}")), (right - left) * 0.5)
                base = base + F.when(F.col("relation") == COARSER, _sign(cfg, d) * slope * 0.25).otherwise(0.0)
            return base

        return got.select("key", *cfg.axes, *[value(n).alias(n) for n in names])
    weights = INTERPOLATION[prolongation]
    reach = len(weights) // 2
    steps = [s for s in product(range(-reach, reach + 1), repeat=cfg.dim) if any(s)]
    rich = with_steps(cells, old, cfg, names, steps)
    # the new cell's place in the coarse one chooses a set of weights: one weighted sum for each of the 2^dim places, fetched like a value
    halves = list(product((0, 1), repeat=cfg.dim))

    def combined(n: str, half: tuple[int, ...]) -> Column:
        total = F.col(n) * 1.0
        for k, step in enumerate(steps):
            w = 1.0
            for h, s in zip(half, step, strict=True):
                w *= weights[reach - s if h else reach + s]
            total = total + F.col(f"{n}_s{k}") * w
        return total

    rich = rich.select("key", *cfg.axes, *names, *[combined(n, h).alias(f"{n}_h{i}") for n in names for i, h in enumerate(halves)])
    got = fetched(places, rich, cfg, [*names, *[f"{n}_h{i}" for n in names for i in range(len(halves))]])

    def interpolated(n: str) -> Column:
        out = F.col(f"n_{n}")
        for i, half in enumerate(halves):
            here = F.col("relation") == COARSER
            for a, h in zip(cfg.axes, half, strict=True):
                here = here & (F.col(a) % 2 == h)
            out = F.when(here, F.col(f"n_{n}_h{i}")).otherwise(out)
        return out

    return got.select("key", *cfg.axes, *[interpolated(n).alias(n) for n in names])


def material_remapped(new: DataFrame, cells: DataFrame, old: DataFrame, cfg: Config, name: str) -> DataFrame:
    """Cell values by material (key, axes, mat, value) on the new leaves, by copies and means; a material that a cell doesn't have counts as 0 in a mean."""
    places = matched(new, old, cfg)
    half = [F.call_function("div", F.col(a), F.lit(2)).cast("int").alias(f"t{a}") for a in cfg.axes]
    single = cells.select(F.col("key").alias("at"), F.lit(0).alias("fine"), *[F.col(a).cast("int").alias(f"t{a}") for a in cfg.axes], "mat", F.col(name).cast("double").alias(name))
    means = cells.groupBy(F.col("key").alias("at"), *half, "mat").agg((F.sum(name) / (1 << cfg.dim)).alias(name)).withColumn("fine", F.lit(1))
    found = places.join(single.unionByName(means.select(single.columns)), ["at", "fine", *[f"t{a}" for a in cfg.axes]])
    return found.select("key", *cfg.axes, "mat", name)


def leaf_remapped(new: DataFrame, values: DataFrame, cfg: Config, names: list[str]) -> DataFrame:
    """Values by leaf (one cell a block) on new leaves: a leaf's own, its father's, or the mean of its children's."""
    build = _build(values.select("key"), cfg).join(values.select(F.col("key").alias("leaf"), *names), "leaf")
    found = new.select("key").join(build, F.col("key") == F.col("at"))
    return found.groupBy("key").agg(*[F.avg(n).alias(n) for n in names])


def presence_remapped(new: DataFrame, presence: DataFrame, cfg: Config) -> DataFrame:
    """(key, mask): a leaf's own materials, its father's, or the union of its children's."""
    build = _build(presence.select("key"), cfg).join(presence.select(F.col("key").alias("leaf"), "mask"), "leaf")
    found = new.select("key").join(build, F.col("key") == F.col("at"))
    return found.groupBy("key").agg(F.bit_or("mask").alias("mask"))


__all__ = ["SAME", "lattice", "matched", "material_remapped", "presence_remapped", "remapped"]
