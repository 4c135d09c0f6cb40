"""Reductions over cells and meshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .fields import dx
from .mesh import Config


def volume(cfg: Config) -> Column:
    return F.pow(dx(cfg), F.lit(cfg.dim))


def volume_integrals(cells: DataFrame, cfg: Config, names: list[str]) -> DataFrame:
    return cells.agg(*[F.sum(volume(cfg) * F.col(n)).alias(n) for n in names])


def material_integrals(cells: DataFrame, cfg: Config, name: str) -> DataFrame:
    return cells.groupBy("mat").agg(F.sum(volume(cfg) * F.col(name)).alias(name))


def relative_error(test: DataFrame, reference: DataFrame, cfg: Config, name: str, norm: str = "l1", over: str | None = None) -> DataFrame:
    """Not weighted by volume; null where the reference is zero throughout; with ``over`` of quotients by that column, each side's own."""
    value = F.col(name) if over is None else F.col(name) / F.col(over)
    both = test.select("key", *cfg.axes, value.alias("a")).join(reference.select("key", *cfg.axes, value.alias("b")), ["key", *cfg.axes])
    d = F.col("a") - F.col("b")
    if norm == "l1":
        return both.agg((F.sum(F.abs(d)) / F.nullif(F.sum(F.abs("b")), F.lit(0.0))).alias("error"))
    return both.agg((F.sqrt(F.sum(d * d)) / F.nullif(F.sqrt(F.sum(F.col("b") * F.col("b"))), F.lit(0.0))).alias("error"))


def conservation(before: DataFrame, after: DataFrame, cfg: Config, names: list[str]) -> DataFrame:
    """name, reference, test, absolute and relative difference of each volume integral."""
    melt = lambda df, c: volume_integrals(df, cfg, names).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias(c)) for n in names])).alias("e")).select("e.*")
    both = melt(before, "reference").join(melt(after, "test"), "name")
    diff = F.abs(F.col("test") - F.col("reference"))
    return both.select("name", "reference", "test", diff.alias("absolute"), F.when(F.col("reference") != 0, diff / F.abs("reference")).alias("relative"))


def level_histogram(leaves: DataFrame, cfg: Config) -> DataFrame:
    """level, leaves, share of leaves and of volume, by one aggregation over at most a few dozen levels."""
    counts = leaves.groupBy(K.level(F.col("key"), cfg.dim).alias("level")).agg(F.count("*").alias("leaves"))
    part = F.col("leaves") * F.pow(F.lit(2.0), -cfg.dim * F.col("level"))
    whole = Window.partitionBy()
    return counts.select("level", "leaves", (F.col("leaves") / F.sum("leaves").over(whole)).alias("share"), (part / F.sum(part).over(whole)).alias("volume_share"))


def sparsity(leaves: DataFrame, cfg: Config) -> DataFrame:
    """Leaves against those of a uniform mesh of the finest level present."""
    level = K.level(F.col("key"), cfg.dim)
    trees = 1
    for n in cfg.brick:
        trees *= n
    return leaves.agg((F.count("*") / (trees * F.pow(F.lit(2.0), cfg.dim * F.max(level)))).alias("sparsity"))


def time_step(cells: DataFrame, cfg: Config, speed: Column, cfl: float, now: float, end: float) -> DataFrame:
    """The smallest dx / speed times cfl, clipped to the end time."""
    return cells.agg(F.least(F.min(dx(cfg) / speed) * cfl, F.lit(end - now)).alias("dt"))


def flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("flag").agg(F.count("*").alias("leaves"))


def offsets(counts: DataFrame, group: Column, order: str, n: str) -> DataFrame:
    """Exclusive prefix sums within groups."""
    return counts.withColumn("offset", F.coalesce(F.sum(n).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def reductions(df: DataFrame, column: str) -> DataFrame:
    """One row of all the reductions that communicators offer, of an integer column; the product is that of the signs (-1 for odd values), which stays finite on any number of rows."""
    c = F.col(column)
    return df.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"), F.bit_or(c).alias("bor"), F.bit_and(c).alias("band"), F.bool_or(c != 0).alias("lor"), F.bool_and(c != 0).alias("land"), F.product(F.when(c % 2 == 0, 1.0).otherwise(-1.0)).alias("prod"))


def binomials(spark, n: int) -> DataFrame:
    """All binomial coefficients up to row n."""
    rows = spark.range(n + 1).select(F.col("id").cast("int").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id").cast("int"))).alias("k"))
    return rows.select("n", "k", F.round(F.factorial("n") / (F.factorial("k") * F.factorial(F.col("n") - F.col("k")))).cast("long").alias("value"))


def line_slice(cells: DataFrame, cfg: Config, names: list[str], axis: int, at: tuple[float, ...], begin: float = 0.0, end: float = 1.0) -> DataFrame:
    """Cells that a line parallel to an axis goes through: their transverse extents strictly hold ``at`` (its own axis ignored), their centres lie strictly between begin and end."""
    from ..functions.geometry import cell_centre, real_space

    centre = real_space(cell_centre(F.col("key"), [F.col(a) for a in cfg.axes], cfg.block, cfg.dim), cfg.low, cfg.scale)
    keep = (centre[axis] > begin) & (centre[axis] < end)
    for d in range(cfg.dim):
        if d != axis:
            keep = keep & (F.abs(centre[d] - at[d]) < dx(cfg) * 0.5)
    rows = cells.filter(keep)
    return rows.select("key", *cfg.axes, centre[axis].alias("position"), K.level(F.col("key"), cfg.dim).alias("level"), *names)


def middle_line(cfg: Config) -> tuple[float, ...]:
    """Through the middle of the box, a little off so that it lies on no cell border."""
    return tuple(low + cfg.scale * n / 2 + 1e-5 for low, n in zip(cfg.low, cfg.brick, strict=True))
