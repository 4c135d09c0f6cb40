"""Halos of blocks, and physical borders."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.geometry import cell_centre, real_space
from .mesh import Config
from .neighbors import OUTSIDE, fetched, located


def halo_probes(leaves: DataFrame, cfg: Config, width: int) -> DataFrame:
    """(key, axes) of all cells in a halo of ``width`` around each block."""
    spots = [s for s in product(*[range(-width, n + width) for n in cfg.block]) if not all(0 <= c < n for c, n in zip(s, cfg.block, strict=True))]
    lattice = F.array(*[F.struct(*[F.lit(c).alias(a) for a, c in zip(cfg.axes, s, strict=True)]) for s in spots])
    return leaves.select("key", F.explode(lattice).alias("p")).select("key", "p.*")


def filled(cells: DataFrame, leaves: DataFrame, cfg: Config, width: int, names: list[str], borders: dict[int, str] | None = None, momenta: dict[int, str] | None = None, given: Callable[[list[Column], str], Column] | None = None) -> DataFrame:
    """The cells and their halo (is_ghost): copies from leaves of the same level, the surrounding cell of coarser ones, means of finer ones.

    Beyond borders that aren't periodic: ``borders`` names for each face zero_gradient (the default: the nearest own cell), wall, which mirrors and turns the sign of
    the momentum named for that axis in ``momenta``, analytical or custom, which take what ``given`` makes of a ghost cell's centre and a name, or none, which leaves null.
    """
    probes = halo_probes(leaves, cfg, width)
    places = located(probes, leaves, cfg)
    flips = {n: F.lit(1.0) for n in names}
    instead: list[tuple[Column, str]] = []
    if borders:
        for d, (a, n) in enumerate(zip(cfg.axes, cfg.block, strict=True)):
            for face in (2 * d, 2 * d + 1):
                # a ghost across a corner may lie beyond another border alone
                beyond = (F.col("status") == OUTSIDE) & (F.col(a) >= n if face & 1 else F.col(a) < 0) & K.at_domain_border(F.col("key"), face, cfg.brick, cfg.dim)
                if borders.get(face) in ("analytical", "custom", "none"):
                    instead.append((beyond, borders[face]))
                if borders.get(face) == "wall":
                    mirror = 2 * n - 1 - F.col(a) if face & 1 else -F.col(a) - 1
                    places = places.withColumn(f"t{a}", F.when(beyond, mirror).otherwise(F.col(f"t{a}")).cast("int"))
                    if momenta and momenta.get(d) in flips:
                        flips[momenta[d]] = F.when(beyond, -flips[momenta[d]]).otherwise(flips[momenta[d]])
    ghosts = fetched(places, cells, cfg, names)
    centre = real_space(cell_centre(F.col("key"), [F.col(a) for a in cfg.axes], cfg.block, cfg.dim), cfg.low, cfg.scale)

    def value(n: str) -> Column:
        out = F.col(f"n_{n}") * flips[n]
        for beyond, kind in instead:
            out = F.when(beyond, F.lit(None) if kind == "none" else given(centre, n)).otherwise(out)
        return out.cast("double")

    ghosts = ghosts.select("key", *cfg.axes, *[value(n).alias(n) for n in names], F.lit(True).alias("is_ghost"))
    return cells.select("key", *cfg.axes, *[F.col(n).cast("double").alias(n) for n in names], F.lit(False).alias("is_ghost")).unionByName(ghosts)


def inner(cells: DataFrame) -> DataFrame:
    return cells.filter("not is_ghost").drop("is_ghost")
