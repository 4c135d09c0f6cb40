"""Neighbour lookup across levels: one join for leaves, one for cell values.

``located`` finds for each probe cell (key and block coordinates, possibly outside the block) the cell that holds its place: in the same block, in a leaf of the same level, in a
coarser one (the cell around it) or in finer ones (the aligned cells within it, whose mean counts). Beyond a border that isn't periodic, and where there is no leaf,
a probe falls back to the nearest cell of its own block. ``fetched`` joins the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from .mesh import Config

#: Status of a neighbour.
SAME, COARSER, FINER, OUTSIDE, NONE, OWN = 0, 1, 2, 3, 4, 5


def _build(leaves: DataFrame, cfg: Config) -> DataFrame:
    """Rows under which a leaf can be found: its own key, its children's (it is coarser there), its father's (it is finer there)."""
    key = F.col("key")
    own = F.array(F.struct(key.alias("at"), F.lit(SAME).alias("status"), F.lit(0).alias("which")))
    below = F.transform(F.array(*K.children(key, cfg.dim)), lambda k: F.struct(k.alias("at"), F.lit(COARSER).alias("status"), F.lit(0).alias("which")))
    above = F.when(K.level(key, cfg.dim) > 0, F.array(F.struct(K.father(key, cfg.dim).alias("at"), F.lit(FINER).alias("status"), K.child_id(key, cfg.dim).alias("which")))).otherwise(F.expr("cast(array() as array<struct<at:bigint,status:int,which:int>>)"))
    return leaves.select(key.alias("leaf"), F.explode(F.concat(own, below, above)).alias("b")).select("leaf", "b.*")


def leaf_neighbors(leaves: DataFrame, cfg: Config, directions=None) -> DataFrame:
    """(key, dx, dy[, dz], target, status, leaf): the same-level key in each direction and the leaf that covers it; for finer leaves the one that touches with the smallest id."""
    key = F.col("key")
    names = [f"d{a}" for a in "xyz"[: cfg.dim]]
    around = [F.struct(*[F.lit(s).alias(n) for n, s in zip(names, d, strict=True)], K.neighbor(key, d, cfg.brick, cfg.periodic, cfg.dim).alias("target"), F.lit(sum((1 << a) for a, s in enumerate(d) if s < 0)).alias("touch")) for d in directions or cfg.directions]
    probes = leaves.select("key", F.explode(F.array(*around)).alias("p")).select("key", "p.*")
    build = _build(leaves, cfg)
    hit = (F.col("target") == F.col("at")) & ((F.col("status") != FINER) | (F.col("which") == F.col("touch")))
    joined = probes.join(build, hit, "left")
    status = F.when(K.is_outside(F.col("target"), cfg.dim), OUTSIDE).otherwise(F.coalesce("status", F.lit(NONE)))
    return joined.select("key", *names, "target", status.cast("int").alias("status"), "leaf")


def across_face(leaves: DataFrame, cfg: Config, face: int) -> DataFrame:
    """(key, status, leaf): every leaf that touches one across a face, 2^(dim-1) of them where it is finer."""
    d, step = face // 2, 1 if face & 1 else -1
    key = F.col("key")
    probes = leaves.select("key", K.neighbor(key, tuple(step if k == d else 0 for k in range(cfg.dim)), cfg.brick, cfg.periodic, cfg.dim).alias("target"))
    facing = F.col("which").bitwiseAND(F.lit(1 << d)) == (0 if step > 0 else 1 << d)
    found = probes.filter(~K.is_outside(F.col("target"), cfg.dim)).join(_build(leaves, cfg), (F.col("target") == F.col("at")) & ((F.col("status") != FINER) | facing))
    return found.select("key", "status", "leaf")


def forced_level(leaves: DataFrame, cfg: Config, direction: tuple[int, ...]) -> DataFrame:
    """(key, coarser, finer): the keys one level above and below (the child that touches) in a direction, whether there are such leaves or not, and which of them are leaves."""
    key = F.col("key")
    target = K.neighbor(key, direction, cfg.brick, cfg.periodic, cfg.dim)
    touch = sum(1 << a for a, s in enumerate(direction) if s < 0)
    named = leaves.select("key", K.father(target, cfg.dim).alias("coarser"), K.child(target, touch, cfg.dim).alias("finer"))
    known = lambda c: leaves.select(F.col("key").alias(c), F.lit(True).alias(f"has_{c}"))
    out = named.join(known("coarser"), "coarser", "left").join(known("finer"), "finer", "left")
    return out.select("key", "coarser", "finer", *[F.coalesce(f"has_{c}", F.lit(False)).alias(f"has_{c}") for c in ("coarser", "finer")])


def presence_halo(presence: DataFrame, cfg: Config) -> DataFrame:
    """(key, mask): the materials of a leaf and of all leaves around it, across faces, edges and corners; finer ones that touch it."""
    leaves = presence.select("key")
    key = F.col("key")
    steps = [F.struct(K.neighbor(key, d, cfg.brick, cfg.periodic, cfg.dim).alias("target"), *[F.lit(s).alias(f"d{k}") for k, s in enumerate(d)]) for d in cfg.directions]
    probes = leaves.select("key", F.explode(F.array(*steps)).alias("p")).select("key", "p.*").filter(~K.is_outside(F.col("target"), cfg.dim))
    facing = F.lit(True)
    for k in range(cfg.dim):  # a finer leaf counts if it lies on the near side along every axis of the direction
        high = F.col("which").bitwiseAND(F.lit(1 << k)) != 0
        facing = facing & ((F.col(f"d{k}") == 0) | ((F.col(f"d{k}") > 0) & ~high) | ((F.col(f"d{k}") < 0) & high))
    near = probes.join(_build(leaves, cfg), (F.col("target") == F.col("at")) & ((F.col("status") != FINER) | facing)).select("key", "leaf")
    every = near.unionByName(leaves.select("key", F.col("key").alias("leaf")))
    return every.join(presence.select(F.col("key").alias("leaf"), "mask"), "leaf").groupBy("key").agg(F.bit_or("mask").alias("mask"))


def conformal(leaves: DataFrame, cfg: Config, faces_only: bool = True) -> DataFrame:
    """One row for each leaf with a status column for each face (or each direction)."""
    directions = [d for d in cfg.directions if not faces_only or sum(map(abs, d)) == 1]
    names = [f"d{a}" for a in "xyz"[: cfg.dim]]
    found = leaf_neighbors(leaves, cfg, directions)
    label = lambda d: "s_" + "".join("m0p"[s + 1] for s in d)
    one = lambda d: F.max(F.when(_same(names, d), F.col("status"))).alias(label(d))
    return found.groupBy("key").agg(*[one(d) for d in directions])


def _same(names, d) -> Column:
    out = F.lit(True)
    for n, s in zip(names, d, strict=True):
        out = out & (F.col(n) == s)
    return out


def packed_status(statuses: list[Column]) -> Column:
    """Statuses packed two bits each, as far as they are 0..3."""
    out = F.lit(0).cast("long")
    for i, s in enumerate(statuses):
        out = out.bitwiseOR(F.call_function("shiftleft", F.least(s, F.lit(3)).cast("long"), F.lit(2 * i)))
    return out


def located(probes: DataFrame, leaves: DataFrame, cfg: Config) -> DataFrame:
    """Adds at (leaf), fine (0 or 1), t<axis> and status to probes with key and the block's axes; ``fine`` 1 means the mean of the aligned cells around t."""
    names = [f"d{a}" for a in "xyz"[: cfg.dim]]
    step = [F.when(F.col(a) < 0, -1).when(F.col(a) >= n, 1).otherwise(0) for a, n in zip(cfg.axes, cfg.block, strict=True)]
    rows = probes.withColumns({f"_{n}": s.cast("int") for n, s in zip(names, step, strict=True)})
    inside = F.lit(True)
    for n in names:
        inside = inside & (F.col(f"_{n}") == 0)
    around = leaf_neighbors(leaves, cfg).withColumnsRenamed({n: f"_{n}" for n in names} | {"status": "_status", "target": "_target", "leaf": "_leaf"})
    own = rows.filter(inside).withColumns({"_target": F.col("key"), "_status": F.lit(OWN), "_leaf": F.col("key")})
    out = rows.filter(~inside).join(around, ["key", *[f"_{n}" for n in names]], "left").withColumn("_status", F.coalesce("_status", F.lit(NONE)))
    rows = own.unionByName(out.select(own.columns))
    coarse, fine = F.col("_status") == COARSER, F.col("_status") == FINER
    lost = F.col("_status").isin(OUTSIDE, NONE)
    target, bits = {}, F.lit(0)
    for d, (a, n) in enumerate(zip(cfg.axes, cfg.block, strict=True)):
        wrapped = F.pmod(F.col(a), F.lit(n))
        bit = K.child_id(F.col("_target"), cfg.dim).bitwiseAND(F.lit(1 << d))
        around_ = F.call_function("div", wrapped + F.when(bit != 0, n).otherwise(0), F.lit(2))
        within = wrapped - F.when(wrapped * 2 >= n, n // 2).otherwise(0)
        nearest = F.least(F.greatest(F.col(a), F.lit(0)), F.lit(n - 1))
        target[f"t{a}"] = F.when(lost, nearest).when(coarse, around_).when(fine, within).otherwise(wrapped).cast("int")
        bits = bits + F.when(wrapped * 2 >= n, 1 << d).otherwise(0)
    at = F.when(lost, F.col("key")).when(fine, K.child(F.col("_target"), bits, cfg.dim)).otherwise(F.col("_leaf"))
    return rows.withColumns({"at": at, "fine": fine.cast("int"), "status": F.col("_status")} | target).drop("_target", "_status", "_leaf", *[f"_{n}" for n in names])


def _both(cells: DataFrame, cfg: Config, names: list[str]) -> DataFrame:
    """Cell values, and the means of aligned groups of 2^dim cells under halved coordinates."""
    half = [F.call_function("div", F.col(a), F.lit(2)).cast("int").alias(f"t{a}") for a in cfg.axes]
    single = cells.select(F.col("key").alias("at"), F.lit(0).alias("fine"), *[F.col(a).cast("int").alias(f"t{a}") for a in cfg.axes], *[F.col(n).cast("double").alias(f"n_{n}") for n in names])
    means = cells.groupBy(F.col("key").alias("at"), *half).agg(*[F.avg(n).alias(f"n_{n}") for n in names]).withColumn("fine", F.lit(1))
    return single.unionByName(means.select(single.columns))


def fetched(places: DataFrame, cells: DataFrame, cfg: Config, names: list[str]) -> DataFrame:
    """Adds n_<name> for each name to located probes."""
    return places.join(_both(cells, cfg, names), ["at", "fine", *[f"t{a}" for a in cfg.axes]], "left").drop("at", "fine", *[f"t{a}" for a in cfg.axes])


def shifted(cells: DataFrame, leaves: DataFrame, cfg: Config, shift: tuple[int, ...], names: list[str], suffix: str) -> DataFrame:
    """The cells with ``<name><suffix>``: the values one shift away; beyond borders the cell's nearest own one."""
    original = {a: f"_{a}0" for a in cfg.axes}
    moved = cells.withColumns({o: F.col(a) for a, o in original.items()}).withColumns({a: (F.col(o) + s).cast("int") for (a, o), s in zip(original.items(), shift, strict=True)})
    found = fetched(located(moved, leaves, cfg), cells, cfg, names)
    out = found.withColumns({a: F.col(o) for a, o in original.items()}).drop(*original.values(), "status")
    return out.withColumnsRenamed({f"n_{n}": f"{n}{suffix}" for n in names})
