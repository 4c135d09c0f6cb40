"""Meshes as DataFrames of leaf keys: creation, refinement, coarsening, 2:1 balance, partition, borders.

A mesh is a DataFrame with a column ``key`` and a ``Config``. Flags are -1 (coarsen), 0 (keep) and 1 (refine).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..plans.cuts import cut


@dataclass(frozen=True)
class Config:
    dim: int = 2
    brick: tuple[int, ...] = (1, 1)
    periodic: tuple[bool, ...] = (True, True)
    block: tuple[int, ...] = (4, 4)
    low: tuple[float, ...] = (0.0, 0.0)
    scale: float = 1.0
    level_min: int = 0
    level_max: int = 8

    @property
    def high(self) -> tuple[float, ...]:
        """The corner opposite to ``low``."""
        return tuple(a + n * self.scale for a, n in zip(self.low, self.brick, strict=True))

    @property
    def axes(self) -> tuple[str, ...]:
        return ("i", "j", "k")[: self.dim]

    @property
    def directions(self) -> list[tuple[int, ...]]:
        return [d for d in product((-1, 0, 1), repeat=self.dim) if any(d)]


def uniform(spark: SparkSession, cfg: Config, level: int) -> DataFrame:
    """All leaves of one level."""
    each = 1 << (cfg.dim * level)
    trees = 1
    for n in cfg.brick:
        trees *= n
    ids = spark.range(trees * each)
    code, tree = F.col("id") % each, F.call_function("div", F.col("id"), F.lit(each))
    coords = [F.call_function("shiftleft", c, F.lit(K.LAYOUTS[cfg.dim].max_level - level)) for c in K.morton_coords(code, cfg.dim, max(level, 1))]
    return ids.select(K.encode(K.cell_coords(tree, cfg.brick), coords, F.lit(level)).alias("key"))


def described(leaves: DataFrame, cfg: Config) -> DataFrame:
    """The columns of the quadrants table for each key."""
    key = F.col("key")
    trees, coords = K.tree_coords(key, cfg.dim), K.octant_coords(key, cfg.dim)
    names = [*[f"tree_{a}" for a in "xyz"[: cfg.dim]], *[f"o{a}" for a in "xyz"[: cfg.dim]]]
    return leaves.withColumns(dict(zip(names, [*trees, *coords], strict=True)) | {"level": K.level(key, cfg.dim), "morton": K.morton_octant(key, cfg.dim), "outside": K.outside_status(key, cfg.dim)})


def refine(flagged: DataFrame, cfg: Config) -> DataFrame:
    """(key, flag) with every leaf flagged 1 below the deepest level replaced by its children, which carry 0."""
    key = F.col("key")
    split = (F.col("flag") == 1) & (K.level(key, cfg.dim) < cfg.level_max)
    rows = F.when(split, F.transform(F.array(*K.children(key, cfg.dim)), lambda k: F.struct(k.alias("key"), F.lit(0).alias("flag")))).otherwise(F.array(F.struct(key.alias("key"), F.when(F.col("flag") == 1, 0).otherwise(F.col("flag")).cast("int").alias("flag"))))
    return flagged.select(F.explode(rows).alias("r")).select("r.key", "r.flag")


def coarsen(flagged: DataFrame, cfg: Config, delay: int = 0) -> DataFrame:
    """(key, flag) with complete families that all ask for it replaced by their fathers: one aggregation, no second join.

    With a ``delay``, leaves whose column ``age`` (cycles since they were made; negative: never adapted) is 0 up to it keep their families as they are.
    """
    key = F.col("key")
    wants = (F.col("flag") == -1) & (K.level(key, cfg.dim) > cfg.level_min)
    if delay:
        wants = wants & ~F.col("age").between(0, delay)
    rows = flagged.withColumn("wants", wants)
    alone = rows.filter("not wants").select("key", "flag")
    families = rows.filter("wants").groupBy(K.father(key, cfg.dim).alias("father")).agg(F.collect_list("key").alias("members"))
    merged = F.when(F.size("members") == 1 << cfg.dim, F.array(F.struct(F.col("father").alias("key"), F.lit(0).alias("flag")))).otherwise(F.transform("members", lambda k: F.struct(k.alias("key"), F.lit(-1).alias("flag"))))
    return alone.unionByName(families.select(F.explode(merged).alias("r")).select("r.key", "r.flag"))


def ancestor(key, level, dim: int):
    """The ancestor at a level (a literal not below the key's own)."""
    k = K.LAYOUTS[dim]
    at = k.morton_at + (k.max_level - level) * dim
    return K.with_field(F.call_function("shiftleft", K.shr(key, at), F.lit(at)).bitwiseOR(K.outside_status(key, dim)), F.lit(level), k.outside, k.level)


def _too_coarse(leaves: DataFrame, cfg: Config) -> DataFrame:
    """Leaves with a face, edge or corner neighbour two or more levels finer."""
    key, level = F.col("key"), K.level(F.col("key"), cfg.dim)
    around = F.array(*[K.neighbor(key, d, cfg.brick, cfg.periodic, cfg.dim) for d in cfg.directions])
    near = leaves.filter(level >= 2).select(F.explode(around).alias("key")).filter(~K.is_outside(F.col("key"), cfg.dim)).distinct()
    above = F.array(*[F.when(level >= to + 2, ancestor(key, to, cfg.dim)) for to in range(max(cfg.level_max - 1, 1))])
    probes = near.select(F.explode(F.filter(above, lambda x: x.isNotNull())).alias("key")).distinct()
    return leaves.select("key").join(probes, "key", "left_semi")


def is_balanced(leaves: DataFrame, cfg: Config) -> bool:
    return _too_coarse(leaves, cfg).isEmpty()


def balance(leaves: DataFrame, cfg: Config) -> DataFrame:
    """Split leaves until none touches one more than a level finer; at most level_max rounds, each checkpointed."""
    now = cut(leaves.select("key"))
    for _ in range(cfg.level_max + 1):
        bad = cut(_too_coarse(now, cfg))
        if bad.isEmpty():
            break
        kids = bad.select(F.explode(F.array(*K.children(F.col("key"), cfg.dim))).alias("key"))
        now = cut(now.join(bad, "key", "left_anti").unionByName(kids))
    return now


def adapt(flagged: DataFrame, cfg: Config) -> tuple[DataFrame, bool]:
    """Refine, coarsen, balance if anything changed; returns the new leaves and whether they differ."""
    done = cut(coarsen(refine(flagged, cfg), cfg).select("key"))
    changed = not done.join(flagged.select("key"), "key", "left_anti").isEmpty()
    return (balance(done, cfg), True) if changed else (done, False)


def indexed(leaves: DataFrame, cfg: Config) -> DataFrame:
    """``index_in_level``: the rank of each leaf among those of its level in key order."""
    level = K.level(F.col("key"), cfg.dim)
    return leaves.withColumn("level", level).withColumn("index_in_level", (F.row_number().over(Window.partitionBy("level").orderBy(K.ordered(F.col("key")))) - 1).cast("long"))


def partitioned(weighted: DataFrame, parts: int, by_family: bool = False, dim: int = 2) -> DataFrame:
    """``part`` 0..parts-1 along the key order with near equal weights (columns key, weight).

    Prefix sums in two steps: totals of coarse key ranges, then within each, so no task sees all rows. With ``by_family`` siblings stay together.
    """
    order = K.ordered(K.oldest_brother(F.col("key"), dim) if by_family else F.col("key"))
    k = K.LAYOUTS[dim]
    coarse = F.call_function("shiftright", K.ordered(F.col("key")), F.lit(k.tree_at - 4 * dim))
    rows = weighted.withColumns({"_order": order, "_range": coarse})
    totals = rows.groupBy("_range").agg(F.sum("weight").alias("_sum"))  # at most 2**(4 dim) rows for each tree
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("_all", F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    within = Window.partitionBy("_range").orderBy("_order")
    within = within.rangeBetween(Window.unboundedPreceding, Window.currentRow) if by_family else within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(before, "_range").withColumn("_upto", F.col("_before") + F.sum("weight").over(within))
    part = F.least(F.floor((F.col("_upto") - (0 if by_family else F.col("weight"))) * parts / F.greatest(F.col("_all"), F.lit(1))), F.lit(parts - 1)).cast("int")
    return joined.withColumn("part", part).drop("_range", "_order", "_sum", "_before", "_all", "_upto")


def outside(leaves: DataFrame, cfg: Config) -> DataFrame:
    """Keys beyond the borders that aren't periodic: mirror images across faces, edges and corners."""
    key = F.col("key")
    around = F.array(*[K.neighbor(key, d, cfg.brick, cfg.periodic, cfg.dim) for d in cfg.directions])
    return leaves.select(F.explode(around).alias("key")).filter(K.is_outside(F.col("key"), cfg.dim)).distinct()


def nodes(leaves: DataFrame, cfg: Config) -> DataFrame:
    """Distinct corner points in units of the finest level, over all trees."""
    key, root = F.col("key"), K.LAYOUTS[cfg.dim].root
    base = [t * root + c for t, c in zip(K.tree_coords(key, cfg.dim), K.octant_coords(key, cfg.dim), strict=True)]
    size = K.length(key, cfg.dim)
    points = [F.struct(*[(b + (size if corner >> d & 1 else 0)).alias("xyz"[d]) for d, b in enumerate(base)]) for corner in range(1 << cfg.dim)]
    return leaves.select(F.explode(F.array(*points)).alias("p")).select("p.*").distinct()


def brick_trees(brick: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The coordinates of a brick's trees in the order of their numbers: bits of the coordinates interleaved, an axis falling out where its bits end; codes outside the brick are skipped."""
    bits = [(n - 1).bit_length() for n in brick]
    ranked = sorted(range(len(brick)), key=lambda d: bits[d])

    def code(at: tuple[int, ...]) -> int:
        out = place = 0
        for level in range(max(bits, default=0)):
            for d in sorted(ranked):
                if level < bits[d]:
                    out |= (at[d] >> level & 1) << place
                    place += 1
        return out

    return sorted(product(*[range(n) for n in brick]), key=code)


def brick_connectivity(cfg: Config) -> list[tuple[int, int, int]]:
    """(tree, face, neighbouring tree) of a brick; a tree is its own neighbour at a border that isn't periodic."""
    trees = brick_trees(cfg.brick[: cfg.dim])
    number = {at: i for i, at in enumerate(trees)}
    out = []
    for tree, at in enumerate(trees):
        for face in range(2 * cfg.dim):
            d, step = face // 2, 1 if face & 1 else -1
            to = list(at)
            if 0 <= at[d] + step < cfg.brick[d] or cfg.periodic[d]:
                to[d] = (at[d] + step) % cfg.brick[d]
            out.append((tree, face, number[tuple(to)]))
    return out
