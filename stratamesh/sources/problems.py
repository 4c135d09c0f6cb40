"""Initial states of named problems at points: primitive variables as expressions, from the settings of a configuration.

Each takes (settings, coordinates) and reads its own section; a name that is not set has its default. ``initial`` picks one by name.
"""

from __future__ import annotations

import math

from ..functions.algebra import sin, sqrt, where
from .config import Settings

# The defaults of each section.
SOD = {"rhoL": 1.0, "uL": 0.0, "pL": 1.0, "rhoR": 0.125, "uR": 0.0, "pR": 0.1}
SHU_OSHER = {"rhoL": 27 / 7, "uL": 4 * math.sqrt(35) / 9, "pL": 31 / 3, "rhoR": 1.0, "uR": 0.0, "pR": 1.0, "A": 0.2, "k": 5.0, "x0": -4.0}
WOODWARD = {"rhoL": 1.0, "uL": 0.0, "pL": 1000.0, "rhoC": 1.0, "uC": 0.0, "pC": 0.01, "rhoR": 1.0, "uR": 0.0, "pR": 100.0}
BLAST = {"density_in": 1.0, "density_out": 1.2, "pressure_in": 10.0, "pressure_out": 0.1, "bx": 1.0, "by": math.sqrt(3), "bz": 0.0}
ROTOR = {"r0": 0.1, "r1": 0.115, "u0": 2.0, "rho0": 10.0, "rho1": 1.0, "p0": 1.0, "bx": 5 / math.sqrt(4 * math.pi), "by": 0.0, "bz": 0.0}


def _read(settings: Settings, section: str, defaults: dict[str, float]) -> dict[str, float]:
    return {k: settings.number(section, k, v) for k, v in defaults.items()}


def _box(settings: Settings, dim: int) -> tuple[list[float], list[float]]:
    """The lowest and the highest corner of the domain."""
    scale = settings.number("mesh", "scaling_factor", 1.0)
    low = [settings.number("mesh", f"{a}min", 0.0) for a in "xyz"[:dim]]
    return low, [x + scale * settings.integer("mesh", f"nbrick_{a}", 1) for x, a in zip(low, "xyz", strict=False)]


def _centre(settings: Settings, section: str, names: list[str]) -> list[float]:
    low, high = _box(settings, len(names))
    return [settings.number(section, n, (a + b) / 2) for n, a, b in zip(names, low, high, strict=True)]


def _distance(coords, centre):
    first, *rest = [(c - o) * (c - o) for c, o in zip(coords, centre, strict=True)]
    return sqrt(sum(rest, first))


def sod(settings: Settings, coords):
    s, (middle,) = _read(settings, "sod", SOD), _centre(settings, "sod", ["xd"])
    left = coords[0] < middle
    return {k: where(left, s[f"{n}L"], s[f"{n}R"]) for k, n in (("r", "rho"), ("u", "u"), ("p", "p"))}


def shu_osher(settings: Settings, coords):
    """A shock that runs into a wave of density: rhoR (1 + A sin(k x))."""
    s = _read(settings, "shu_osher", SHU_OSHER)
    left = coords[0] < s["x0"]
    return {"r": where(left, s["rhoL"], (sin(coords[0] * s["k"]) * s["A"] + 1.0) * s["rhoR"]), "u": where(left, s["uL"], s["uR"]), "p": where(left, s["pL"], s["pR"])}


def woodward(settings: Settings, coords):
    """Two blast waves that run towards each other from the ends of the x axis."""
    s, ((low, *_), (high, *_)) = _read(settings, "woodward", WOODWARD), _box(settings, 1)
    first, last = settings.number("woodward", "xd_L", low + 0.1 * (high - low)), settings.number("woodward", "xd_R", low + 0.9 * (high - low))
    x = coords[0]
    return {k: where(x < first, s[f"{n}L"], where(x < last, s[f"{n}C"], s[f"{n}R"])) for k, n in (("r", "rho"), ("u", "u"), ("p", "p"))}


def blast(settings: Settings, coords):
    """A ball of other density and pressure at rest in a uniform field; the radius is a tenth of the middle of the x axis unless set."""
    s, centre = _read(settings, "blast", BLAST), _centre(settings, "blast", [f"center_{a}" for a in "xyz"[: len(coords)]])
    low, high = _box(settings, 1)
    inside = _distance(coords, centre) < settings.number("blast", "radius", (low[0] + high[0]) / 2 / 10)
    rest = coords[0] * 0.0
    return {"r": where(inside, s["density_in"], s["density_out"]), "u": rest, "v": rest, "w": rest, "p": where(inside, s["pressure_in"], s["pressure_out"])} | {k: rest + s[k] for k in ("bx", "by", "bz")}


def rotor(settings: Settings, coords):
    """A dense disk in rigid rotation about z, a ring over which density and speed fall in proportion to the distance, and a fluid at rest."""
    s, centre = _read(settings, "rotor", ROTOR), _centre(settings, "rotor", ["xc", "yc"])
    x, y = coords[0] - centre[0], coords[1] - centre[1]
    r = _distance(coords[:2], centre)
    within, ring = r < s["r0"], r < s["r1"]
    fall = (s["r1"] - r) / (s["r1"] - s["r0"])
    turn = where(within, s["u0"] / s["r0"], where(ring, fall * s["u0"] / where(r > 0, r, 1.0), 0.0))
    still = x * 0.0
    return {"r": where(within, s["rho0"], where(ring, fall * (s["rho0"] - s["rho1"]) + s["rho1"], s["rho1"])), "u": turn * y * -1.0, "v": turn * x, "w": still, "p": still + s["p0"]} | {k: still + s[k] for k in ("bx", "by", "bz")}


PROBLEMS = {"sod": sod, "shu_osher": shu_osher, "woodward": woodward, "blast": blast, "rotor": rotor}


def initial(name: str, settings: Settings, coords) -> dict:
    """The initial state of a problem by its name."""
    if name not in PROBLEMS:
        raise ValueError(f"unknown problem {name!r}; known: {', '.join(PROBLEMS)}")
    return PROBLEMS[name](settings, coords)
