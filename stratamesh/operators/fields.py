"""Derived fields and refinement flags from neighbouring cell values."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.geometry import cell_length
from .mesh import Config
from .neighbors import fetched, located

EPSILON = 1e-12


def with_neighbors(cells: DataFrame, leaves: DataFrame, cfg: Config, names: list[str], reach: int = 1) -> DataFrame:
    """The cells with <name>_l<axis><r> and <name>_r<axis><r> for r up to ``reach``: all steps share one lookup, one fetch and one aggregation."""
    steps = [(d, r, s) for d in range(cfg.dim) for r in range(1, reach + 1) for s in (-r, r)]
    origin = [f"_{a}0" for a in cfg.axes]
    moves = [F.struct(F.lit(n).alias("_step"), *[(F.col(a) + (s if k == d else 0)).cast("int").alias(a) for k, a in enumerate(cfg.axes)]) for n, (d, _, s) in enumerate(steps)]
    probes = cells.select("key", *[F.col(a).alias(o) for a, o in zip(cfg.axes, origin, strict=True)], F.explode(F.array(*moves)).alias("_m")).select("key", *origin, "_m.*")
    found = fetched(located(probes, leaves, cfg), cells, cfg, names)
    tag = lambda d, r, s: f"_{'l' if s < 0 else 'r'}{d}{r}"
    wide = found.groupBy("key", *origin).agg(*[F.max(F.when(F.col("_step") == n, F.col(f"n_{v}"))).alias(f"{v}{tag(d, r, s)}") for n, (d, r, s) in enumerate(steps) for v in names])
    return cells.join(wide.withColumnsRenamed(dict(zip(origin, cfg.axes, strict=True))), ["key", *cfg.axes])


def with_steps(cells: DataFrame, leaves: DataFrame, cfg: Config, names: list[str], steps: list[tuple[int, ...]]) -> DataFrame:
    """The cells with <name>_s<n>, the value one of ``steps`` away in any direction, diagonal ones too, by one lookup, fetch and aggregation."""
    origin = [f"_{a}0" for a in cfg.axes]
    moves = [F.struct(F.lit(n).alias("_step"), *[(F.col(a) + s).cast("int").alias(a) for a, s in zip(cfg.axes, step, strict=True)]) for n, step in enumerate(steps)]
    probes = cells.select("key", *[F.col(a).alias(o) for a, o in zip(cfg.axes, origin, strict=True)], F.explode(F.array(*moves)).alias("_m")).select("key", *origin, "_m.*")
    found = fetched(located(probes, leaves, cfg), cells, cfg, names)
    wide = found.groupBy("key", *origin).agg(*[F.max(F.when(F.col("_step") == n, F.col(f"n_{v}"))).alias(f"{v}_s{n}") for n in range(len(steps)) for v in names])
    return cells.join(wide.withColumnsRenamed(dict(zip(origin, cfg.axes, strict=True))), ["key", *cfg.axes])


def linear_combination(cells: DataFrame, leaves: DataFrame, cfg: Config, name: str, axis: int, weights: list[float]) -> DataFrame:
    """Weighted sums of 3 or 5 cells along an axis (weights from the left, the cell itself in the middle); neighbours count with their value at the cell's own level."""
    reach = len(weights) // 2
    steps = [tuple(r if k == axis else 0 for k in range(cfg.dim)) for r in range(-reach, reach + 1) if r]
    rich = with_steps(cells, leaves, cfg, [name], steps)
    terms = [F.col(f"{name}_s{n}") * w for n, w in enumerate([*weights[:reach], *weights[reach + 1 :]])]
    return rich.select("key", *cfg.axes, (_total(terms) + F.col(name) * weights[reach]).alias(name))


def dx(cfg: Config) -> Column:
    return cell_length(K.level(F.col("key"), cfg.dim), cfg.block[0], cfg.dim, cfg.scale)


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _sides(name: str, d: int, r: int = 1) -> tuple[Column, Column]:
    return F.col(f"{name}_l{d}{r}"), F.col(f"{name}_r{d}{r}")


def divergence(cells: DataFrame, leaves: DataFrame, cfg: Config, vector: list[str], central: bool = False) -> DataFrame:
    """Sum of right minus left over dx; ``central`` halves it."""
    rich = with_neighbors(cells, leaves, cfg, vector)
    terms = [_sides(n, d)[1] - _sides(n, d)[0] for d, n in enumerate(vector)]
    return rich.select("key", *cfg.axes, (_total(terms) / dx(cfg) * (0.5 if central else 1.0)).alias("divergence"))


def gradient_norm(cells: DataFrame, leaves: DataFrame, cfg: Config, name: str) -> DataFrame:
    rich = with_neighbors(cells, leaves, cfg, [name])
    half = [(r - l) / (2.0 * dx(cfg)) for l, r in (_sides(name, d) for d in range(cfg.dim))]
    return rich.select("key", *cfg.axes, F.sqrt(_total([h * h for h in half])).alias("gradient"))


def schlieren(cells: DataFrame, leaves: DataFrame, cfg: Config, name: str, scaling: str = "none", k: float = 10.0) -> DataFrame:
    """The gradient's norm, over its global maximum and scaled: none, linear, sqrt, log or exp."""
    g = gradient_norm(cells, leaves, cfg, name)
    if scaling == "none":
        return g.select("key", *cfg.axes, F.col("gradient").alias("schlieren"))
    top = g.agg(F.max("gradient").alias("top"))
    share = F.col("gradient") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)
    scaled = {"linear": share, "sqrt": F.sqrt(share), "log": F.when(share > 0, F.log(share)).otherwise(0.0), "exp": F.exp(-k * share)}[scaling]
    return g.crossJoin(F.broadcast(top)).select("key", *cfg.axes, scaled.alias("schlieren"))  # top is one row


def indicator(cells: DataFrame, leaves: DataFrame, cfg: Config, name: str, kind: str = "lohner_unsplit", epsilon: float = 0.01, a: float = 1.0, b: float = 0.0) -> DataFrame:
    """lohner_split (an array, one for each axis), lohner_unsplit, gradient or affine; as an array ``indicators``."""
    if kind == "affine":
        return cells.select("key", *cfg.axes, F.array(F.col(name) * a + b).alias("indicators"))
    rich = with_neighbors(cells, leaves, cfg, [name])
    c = F.col(name).cast("double")
    pairs = [_sides(name, d) for d in range(cfg.dim)]
    if kind == "gradient":
        jump = lambda x: F.abs(c - x) / F.greatest(F.abs(c), F.abs(x), F.lit(1e-300))
        one = lambda x: F.when(F.greatest(F.abs(c), F.abs(x)) < 1e-3, 0.0).otherwise(F.least(F.greatest(jump(x), F.lit(0.0)), F.lit(1.0)))
        return rich.select("key", *cfg.axes, F.array(F.greatest(*[one(x) for p in pairs for x in p])).alias("indicators"))
    over = [F.abs(l - 2 * c + r) for l, r in pairs]
    under = [F.abs(r - c) + F.abs(c - l) + epsilon * (F.abs(l) + 2 * F.abs(c) + F.abs(r)) + EPSILON for l, r in pairs]
    if kind == "lohner_split":
        return rich.select("key", *cfg.axes, F.array(*[o / u for o, u in zip(over, under, strict=True)]).alias("indicators"))
    return rich.select("key", *cfg.axes, F.array(F.sqrt(_total([o * o for o in over]) / _total([u * u for u in under]))).alias("indicators"))


def flags(indicators: DataFrame, cfg: Config, refine: float, coarsen: float) -> DataFrame:
    """(key, flag): the largest wish over axes and cells of a block."""
    level = K.level(F.col("key"), cfg.dim)
    wish = lambda x: F.when((level < cfg.level_max) & (x > refine), 1).when((level > cfg.level_min) & (x < coarsen), -1).otherwise(0)
    return indicators.groupBy("key").agg(F.max(F.array_max(F.transform("indicators", wish))).cast("int").alias("flag"))


#: Weights of one-sided and central first derivatives, by points and place of the cell in its stencil.
STENCILS = {
    3: {1: {-1: -0.5, 1: 0.5}},
    5: {2: {-2: 1 / 12, -1: -2 / 3, 1: 2 / 3, 2: -1 / 12}},
    7: {3: {-3: -1 / 60, -2: 3 / 20, -1: -3 / 4, 1: 3 / 4, 2: -3 / 20, 3: 1 / 60}},
}


def one_sided(points: int, place: int) -> dict[int, float]:
    """Exact weights of the first derivative on ``points`` equidistant points at ``place``: Lagrange's formula."""
    out = {}
    for m in range(points):
        if m == place:
            continue
        w = 1.0 / (m - place)
        for q in range(points):
            if q not in (m, place):
                w *= (place - q) / (m - q)
        out[m - place] = w
    return out


def derivative(cells: DataFrame, cfg: Config, name: str, axis: int, points: int = 5) -> DataFrame:
    """First derivative within blocks, central where the stencil fits and one-sided near block borders: a positional sum over one sort of each line of cells."""
    n = cfg.block[axis]
    if n < points:
        raise ValueError(f"a {points}-point stencil needs blocks of {points} cells")
    others = [a for k, a in enumerate(cfg.axes) if k != axis]
    along = cfg.axes[axis]
    line = cells.groupBy("key", *others).agg(F.sort_array(F.collect_list(F.struct(F.col(along).alias("p"), F.col(name).cast("double").alias("v")))).alias("line"))  # a line has block-size cells
    half = points // 2
    values = []
    for p in range(n):
        place = p if p < half else points - (n - p) if p >= n - half else half
        c = F.element_at("line", p + 1)["v"]
        w = one_sided(points, place)
        total = _total([(F.element_at("line", p + o + 1)["v"] - c) * x for o, x in w.items()])
        values.append(F.struct(F.lit(p).alias(along), total.alias("d")))
    out = line.select("key", *others, F.explode(F.array(*values)).alias("e"))
    return out.select("key", *others, f"e.{along}", (F.col("e.d") / dx(cfg)).alias("derivative"))


def _derivatives(cells: DataFrame, cfg: Config, names: list[str], points: int) -> DataFrame:
    """The cells with d<axis>, the derivative of the axis' name along it."""
    out = cells
    for d, n in enumerate(names):
        out = out.join(derivative(cells, cfg, n, d, points).withColumnRenamed("derivative", f"d{d}"), ["key", *cfg.axes])
    return out


def normalized_gradient(cells: DataFrame, cfg: Config, name: str, points: int = 5) -> DataFrame:
    """The gradient within blocks over its norm; a norm under 1e-13 counts as 1."""
    rich = _derivatives(cells.select("key", *cfg.axes, name), cfg, [name] * cfg.dim, points)
    norm = F.sqrt(_total([F.col(f"d{d}") * F.col(f"d{d}") for d in range(cfg.dim)]))
    norm = F.when(norm < 1e-13, 1.0).otherwise(norm)
    return rich.select("key", *cfg.axes, *[(F.col(f"d{d}") / norm).alias(f"n{'xyz'[d]}") for d in range(cfg.dim)])


def scaled_divergence(cells: DataFrame, cfg: Config, vector: list[str], factor: float = 1.0, points: int = 5) -> DataFrame:
    """The divergence within blocks times a factor."""
    rich = _derivatives(cells.select("key", *cfg.axes, *vector), cfg, vector, points)
    return rich.select("key", *cfg.axes, (_total([F.col(f"d{d}") for d in range(cfg.dim)]) * factor).alias("divergence"))


def smooth_interface(phi: Column, alpha: float = 0.1) -> Column:
    x, y = F.pow(phi, alpha), F.pow(1 - phi, alpha)
    return x / (x + y)


def interface_normal(cells: DataFrame, leaves: DataFrame, cfg: Config, name: str) -> DataFrame:
    """Unit gradient with fourth-order central differences; a norm under 1e-13 counts as 1."""
    rich = with_neighbors(cells, leaves, cfg, [name], reach=2)
    parts = [((F.col(f"{name}_l{d}2") - F.col(f"{name}_r{d}2")) + 8.0 * (F.col(f"{name}_r{d}1") - F.col(f"{name}_l{d}1"))) / 12.0 for d in range(cfg.dim)]
    norm = F.sqrt(_total([p * p for p in parts]))
    norm = F.when(norm < 1e-13, 1.0).otherwise(norm)
    return rich.select("key", *cfg.axes, *[(p / norm).alias(f"n{'xyz'[d]}") for d, p in enumerate(parts)])


def curvature(normals: DataFrame, leaves: DataFrame, cfg: Config) -> DataFrame:
    """Minus the central divergence of the normal."""
    names = [f"n{a}" for a in "xyz"[: cfg.dim]]
    d = divergence(normals, leaves, cfg, names, central=True)
    return d.select("key", *cfg.axes, (-F.col("divergence")).alias("curvature"))


def filtered_curvature(curved: DataFrame, leaves: DataFrame, cfg: Config, phi: str = "phi", threshold: float = 1e-6, rounds: int = 1) -> DataFrame:
    """Weighted means over 3^dim cells with weights phi^2 (1 - phi)^2, where the weight is above the threshold; curved: key, axes, phi, curvature."""
    now = curved.withColumn("w", F.pow(F.col(phi), 2) * F.pow(1 - F.col(phi), 2))
    for _ in range(rounds):
        base = now.withColumn("wk", F.col("w") * F.col("curvature")).select("key", *cfg.axes, phi, "curvature", "w", "wk")
        steps = [s for s in product((-1, 0, 1), repeat=cfg.dim) if any(s)]
        out = with_steps(base, leaves, cfg, ["w", "wk"], steps)
        top = _total([F.col("wk"), *[F.col(f"wk_s{n}") for n in range(len(steps))]])
        low = _total([F.col("w"), *[F.col(f"w_s{n}") for n in range(len(steps))]])
        value = F.when(F.col("w") > threshold, top / low).otherwise(F.col("curvature"))
        now = out.select("key", *cfg.axes, phi, value.alias("curvature"), "w")
    return now.drop("w")


def smooth_interface_curvature(cells: DataFrame, leaves: DataFrame, cfg: Config, phi: str = "phi", alpha: float = 0.1, points: int = 7, threshold: float = 1e-6, rounds: int = 3) -> DataFrame:
    """Curvature from volume fractions: smooth interface function, its unit gradient, minus the divergence of that, filtered ``rounds`` times."""
    smooth = cells.select("key", *cfg.axes, smooth_interface(F.col(phi), alpha).alias("_s"))
    normal = normalized_gradient(smooth, cfg, "_s", points)
    bent = scaled_divergence(normal, cfg, [f"n{a}" for a in "xyz"[: cfg.dim]], -1.0, points).withColumnRenamed("divergence", "curvature")
    return filtered_curvature(cells.select("key", *cfg.axes, phi).join(bent, ["key", *cfg.axes]), leaves, cfg, phi, threshold, rounds)


def face_divergence(faces: DataFrame, cfg: Config) -> DataFrame:
    """Of a face field (key, dir, axes, v): the differences of a cell's upper and lower faces over dx, in one aggregation."""
    both = []
    for d, a in enumerate(cfg.axes):
        own = F.when((F.col("dir") == d) & (F.col(a) < cfg.block[d]), F.struct(*[F.col(x).alias(x) for x in cfg.axes], (-F.col("v")).alias("v")))
        upper = F.when((F.col("dir") == d) & (F.col(a) > 0), F.struct(*[(F.col(x) - (1 if x == a else 0)).cast("int").alias(x) for x in cfg.axes], F.col("v").alias("v")))
        both += [own, upper]
    rows = faces.select("key", F.explode(F.filter(F.array(*both), lambda x: x.isNotNull())).alias("e")).select("key", "e.*")
    total = rows.groupBy("key", *cfg.axes).agg(F.sum("v").alias("s"))
    return total.select("key", *cfg.axes, (F.col("s") / dx(cfg)).alias("divergence"))


def curl(edges: DataFrame, cfg: Config) -> DataFrame:
    """In two dimensions: from the corner component (key, i, j, v) to faces (key, dir, i, j, v): +d/dy along x, -d/dx along y; lengths without the domain's scale."""
    length = cell_length(K.level(F.col("key"), cfg.dim), cfg.block[0], cfg.dim)
    bx, by = cfg.block
    sides = [
        F.when(F.col("j") < by, F.struct(F.lit(0).alias("dir"), F.col("i"), F.col("j"), (-F.col("v")).alias("v"))),
        F.when(F.col("j") > 0, F.struct(F.lit(0).alias("dir"), F.col("i"), (F.col("j") - 1).alias("j"), F.col("v").alias("v"))),
        F.when(F.col("i") < bx, F.struct(F.lit(1).alias("dir"), F.col("i"), F.col("j"), F.col("v").alias("v"))),
        F.when(F.col("i") > 0, F.struct(F.lit(1).alias("dir"), (F.col("i") - 1).alias("i"), F.col("j"), (-F.col("v")).alias("v"))),
    ]
    rows = edges.select("key", F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())).alias("e")).select("key", "e.*")
    return rows.groupBy("key", "dir", "i", "j").agg(F.sum("v").alias("s")).select("key", "dir", "i", "j", (F.col("s") / length).alias("v"))


def combined(first: DataFrame, second: DataFrame, cfg: Config, name: str, c0: float, c1: float) -> DataFrame:
    """c0 first + c1 second, cell by cell."""
    return first.join(second.select("key", *cfg.axes, F.col(name).alias("_other")), ["key", *cfg.axes]).select("key", *cfg.axes, (c0 * F.col(name) + c1 * F.col("_other")).alias(name))


def with_velocity(cells: DataFrame, u: Column, v: Column) -> DataFrame:
    """Overwrites rho_vx and rho_vy and moves the energy by the change of kinetic energy (columns rho, e_tot, rho_vx, rho_vy)."""
    old = (F.col("rho_vx") * F.col("rho_vx") + F.col("rho_vy") * F.col("rho_vy")) / F.col("rho") * 0.5
    new = F.col("rho") * (u * u + v * v) * 0.5
    return cells.withColumns({"e_tot": F.col("e_tot") + new - old, "rho_vx": F.col("rho") * u, "rho_vy": F.col("rho") * v})
