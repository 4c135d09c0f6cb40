"""States, fluxes and approximate Riemann solvers of gas dynamics and magnetohydrodynamics along the x axis.

States are dictionaries of expressions: primitive r, u, v[, w], p and, with magnetic fields, bx, by, bz. Solvers take a program (see
algebra), so each intermediate value is computed once. Fluxes have the same names, with e for the energy.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from .algebra import absolute, greatest, least, sign, sin, sqrt, where
from .eos import Eos, IdealGas


@dataclass(frozen=True)
class Floors:
    r: float = 1e-8
    c: float = 1e-8
    p: float = 1e-10


VELOCITIES = ("u", "v", "w")


def _speeds(q):
    return [q[k] for k in VELOCITIES if k in q]


def kinetic(q):
    return q["r"] * sum((x * x for x in _speeds(q)[1:]), q["u"] * q["u"]) * 0.5


def primitive(rho, energy, momenta, gamma: float = 1.4, floors: Floors = Floors()):
    """Primitive state and validity of a conservative one (energy and momenta by volume)."""
    r = greatest(rho, floors.r)
    names = VELOCITIES[: len(momenta)]
    q = {"r": r} | {k: m / r for k, m in zip(names, momenta, strict=True)}
    e = energy / r - sum((x * x for x in _speeds(q)[1:]), q["u"] * q["u"]) * 0.5
    q["p"] = greatest(r * e * (gamma - 1), r * floors.p)
    return q, e >= 0


def conservative(q, eos: Eos):
    return {"r": q["r"], "e": eos.energy(q["r"], q["p"]) + kinetic(q)} | {k: q["r"] * q[k] for k in VELOCITIES if k in q}


def euler_flux(q, axis: int = 0, eos: Eos = IdealGas()):
    """The flux of a state along an axis."""
    normal = q[VELOCITIES[axis]]
    mass = q["r"] * normal
    out = {"r": mass, "e": normal * (eos.energy(q["r"], q["p"]) + kinetic(q) + q["p"])}
    for d, k in enumerate(VELOCITIES):
        if k in q:
            out[k] = mass * q[k] + q["p"] if d == axis else mass * q[k]
    return out


def viscous_flux(q, gradient, mu: float, heat=0.0):
    """Along x in two dimensions: gradient has ux, uy, vx, vy."""
    xx = (gradient["ux"] - (gradient["ux"] + gradient["vy"]) * 0.5) * (2 * mu)
    xy = (gradient["vx"] + gradient["uy"]) * mu
    return {"r": q["r"] * 0.0, "u": xx, "v": xy, "e": q["u"] * xx + q["v"] * xy + heat}


def to_characteristic(q, state, eos: Eos = IdealGas()):
    """Amplitudes of the acoustic, entropy and shear waves of a small change ``state`` at q."""
    c = eos.sound_speed(q["r"], q["p"])
    return {"minus": (state["p"] - q["r"] * c * state["u"]) * 0.5 / (c * c), "entropy": state["r"] - state["p"] / (c * c), "shear": state["v"], "plus": (state["p"] + q["r"] * c * state["u"]) * 0.5 / (c * c)}


def from_characteristic(q, w, eos: Eos = IdealGas()):
    c = eos.sound_speed(q["r"], q["p"])
    return {"r": w["minus"] + w["entropy"] + w["plus"], "u": (w["plus"] - w["minus"]) * c / q["r"], "v": w["shear"], "p": (w["minus"] + w["plus"]) * c * c}


def _floored(P, q, floors: Floors):
    r = P.let(greatest(q["r"], floors.r))
    return q | {"r": r, "p": P.let(greatest(q["p"], r * floors.p))}


def llf(P, left, right, eos: Eos = IdealGas(), floors: Floors = Floors()):
    """Local Lax-Friedrichs."""
    a, b = _floored(P, left, floors), _floored(P, right, floors)
    speed = P.let(greatest(absolute(a["u"]) + eos.sound_speed(a["r"], a["p"]), absolute(b["u"]) + eos.sound_speed(b["r"], b["p"])))
    ul, ur, fl, fr = conservative(left, eos), conservative(right, eos), euler_flux(left, 0, eos), euler_flux(right, 0, eos)
    return {k: P.let((fl[k] + fr[k] - speed * (ur[k] - ul[k])) * 0.5) for k in fl}


def _outer(a, b, eos, floors):
    c = greatest(eos.sound_speed(a["r"], a["p"]), eos.sound_speed(b["r"], b["p"]), floors.c)
    return least(a["u"], b["u"]) - c, greatest(a["u"], b["u"]) + c


def hll(P, left, right, eos: Eos = IdealGas(), floors: Floors = Floors()):
    a, b = _floored(P, left, floors), _floored(P, right, floors)
    low, high = _outer(a, b, eos, floors)
    low, high = P.let(least(low, 0.0)), P.let(greatest(high, 0.0))
    ul, ur, fl, fr = conservative(left, eos), conservative(right, eos), euler_flux(left, 0, eos), euler_flux(right, 0, eos)
    return {k: P.let((high * fl[k] - low * fr[k] + low * high * (ur[k] - ul[k])) / (high - low)) for k in fl}


def _contact(P, left, right, eos, floors):
    a, b = _floored(P, left, floors), _floored(P, right, floors)
    low, high = map(P.let, _outer(a, b, eos, floors))
    ml, mr = P.let(a["r"] * (a["u"] - low)), P.let(b["r"] * (high - b["u"]))
    u = P.let((mr * b["u"] + ml * a["u"] + (a["p"] - b["p"])) / (mr + ml))
    p = P.let((mr * a["p"] + ml * b["p"] + ml * mr * (a["u"] - b["u"])) / (mr + ml))
    return a, b, low, high, u, p


def hllc(P, left, right, eos: Eos = IdealGas(), floors: Floors = Floors()):
    """Three waves: the state between them on the side of the contact that faces the interface."""
    a, b, low, high, u, p = _contact(P, left, right, eos, floors)

    def between(q, s):
        e = eos.energy(q["r"], q["p"]) + kinetic(q)
        return q["r"] * (s - q["u"]) / (s - u), ((s - q["u"]) * e - q["p"] * q["u"] + p * u) / (s - u), e

    (rl, el, tl), (rr, er, tr) = between(a, low), between(b, high)
    pick = lambda outer_l, inner_l, inner_r, outer_r: P.let(where(low > 0, outer_l, where(u > 0, inner_l, where(high > 0, inner_r, outer_r))))
    r, v, t, e = pick(a["r"], rl, rr, b["r"]), pick(a["u"], u, u, b["u"]), pick(a["p"], p, p, b["p"]), pick(tl, el, er, tr)
    out = {"r": P.let(r * v), "u": P.let(r * v * v + t), "e": P.let((e + t) * v)}
    for k in VELOCITIES[1:]:
        if k in left:
            out[k] = P.let(r * v * where(out["r"] > 0, a[k], b[k]))
    return out


def hllc_low_mach(P, left, right, eos: Eos = IdealGas(), floors: Floors = Floors(), limit: float = 0.1):
    """HLLC whose acoustic dissipation fades with the local Mach number: phi = sin(pi/2 min(1, Ma / limit))."""
    a, b = _floored(P, left, floors), _floored(P, right, floors)
    low, high = map(P.let, _outer(a, b, eos, floors))
    u = P.let((b["p"] - a["p"] + a["r"] * a["u"] * (low - a["u"]) - b["r"] * b["u"] * (high - b["u"])) / (a["r"] * (low - a["u"]) - b["r"] * (high - b["u"])))
    mach = greatest(absolute(a["u"]) / eos.sound_speed(a["r"], a["p"]), absolute(b["u"]) / eos.sound_speed(b["r"], b["p"]))
    phi = P.let(sin(least(mach / limit, 1.0) * (math.pi / 2)))
    out = {}
    cons = [conservative(q, eos) for q in (a, b)]
    flux = [euler_flux(q, 0, eos) for q in (a, b)]
    star = []
    for q, c, s in ((a, cons[0], low), (b, cons[1], high)):
        f = P.let((s - q["u"]) / (s - u))
        star.append({k: P.let(f * (q["r"] * u if k == "u" else c["e"] + (u - q["u"]) * (q["r"] * u + q["p"] / (s - q["u"])) if k == "e" else c[k])) for k in c})
    for k in cons[0]:
        middle = (flux[0][k] + flux[1][k]) * 0.5 + (phi * low * (star[0][k] - cons[0][k]) + absolute(u) * (star[0][k] - star[1][k]) + phi * high * (star[1][k] - cons[1][k])) * 0.5
        out[k] = P.let(where(low >= 0, flux[0][k], where(high <= 0, flux[1][k], middle)))
    return out


def quasi_exact(P, left, right, gamma: float = 1.4, floors: Floors = Floors(), rounds: int = 10, tolerance: float = 1e-6):
    """Newton steps for the pressure between the waves, unrolled; a row whose step is small enough keeps its value."""
    eos = IdealGas(gamma)
    a, b = _floored(P, left, floors), _floored(P, right, floors)
    g6 = (gamma + 1) / (2 * gamma)
    cl, cr = P.let(a["p"] * a["r"] * gamma), P.let(b["p"] * b["r"] * gamma)
    wl, wr = P.let(sqrt(cl)), P.let(sqrt(cr))
    p = P.let(greatest((wr * a["p"] + wl * b["p"] + wl * wr * (a["u"] - b["u"])) / (wl + wr), 0.0))
    moved = P.let(p * 0.0 + 1.0)
    for _ in range(rounds):
        xl, xr = P.let(sqrt(cl * (1.0 + (p - a["p"]) * g6 / a["p"]))), P.let(sqrt(cr * (1.0 + (p - b["p"]) * g6 / b["p"])))
        ql, qr = P.let(xl * xl * xl * 2.0 / (xl * xl + cl)), P.let(xr * xr * xr * 2.0 / (xr * xr + cr))
        step = P.let(greatest(qr * ql / (qr + ql) * (a["u"] - (p - a["p"]) / xl - b["u"] - (p - b["p"]) / xr), -p))
        step = P.let(where(moved > tolerance, step, 0.0))
        p = P.let(p + step)
        moved = P.let(absolute(step / (p + floors.p)))
    wl, wr = P.let(sqrt(cl * (1.0 + (p - a["p"]) * g6 / a["p"]))), P.let(sqrt(cr * (1.0 + (p - b["p"]) * g6 / b["p"])))
    u = P.let((a["u"] + (a["p"] - p) / wl + b["u"] - (b["p"] - p) / wr) * 0.5)
    s = P.let(sign(u))
    side = lambda x, y: P.let(where(s > 0, x, y))
    r0, u0, p0, w0 = side(a["r"], b["r"]), side(a["u"], b["u"]), side(a["p"], b["p"]), side(wl, wr)
    c0 = P.let(greatest(eos.sound_speed(r0, p0), floors.c))
    r1 = P.let(greatest(r0 / (1.0 + r0 * (p0 - p) / (w0 * w0)), floors.r))
    c1 = P.let(greatest(eos.sound_speed(r1, p), floors.c))
    shock = P.let(w0 / r0 - s * u0)
    head, tail = P.let(where(p >= p0, shock, c0 - s * u0)), P.let(where(p >= p0, shock, c1 - s * u))
    share = P.let(greatest(0.0, least(1.0, (1.0 + (head + tail) / greatest(head - tail, floors.c + absolute(head + tail))) * 0.5)))
    mix = lambda inner, outer: P.let(where(head < 0, outer, where(tail > 0, inner, share * inner + (1.0 - share) * outer)))
    q = {"r": mix(r1, r0), "u": mix(u, u0), "p": mix(p, p0)} | {k: side(a[k], b[k]) for k in VELOCITIES[1:] if k in left}
    return {k: P.let(f) for k, f in euler_flux(q, 0, eos).items()}


SOLVERS = {"llf": llf, "hll": hll, "hllc": hllc, "hllc_lm": hllc_low_mach, "approx": quasi_exact}


def solve(kind: str, P, left, right, **options):
    """The solver of a configuration's name."""
    if kind not in SOLVERS:
        raise ValueError(f"unknown Riemann solver {kind!r}; known: {', '.join(SOLVERS)}")
    return SOLVERS[kind](P, left, right, **options)


# Magnetohydrodynamics

FIELDS = ("bx", "by", "bz")


def magnetic_pressure(q):
    return (q["bx"] * q["bx"] + q["by"] * q["by"] + q["bz"] * q["bz"]) * 0.5


def fast_speed(q, axis: int = 0, gamma: float = 1.4):
    """The fast magnetosonic speed along an axis."""
    c2 = q["p"] * gamma / q["r"]
    half = (magnetic_pressure(q) * 2.0 / q["r"] + c2) * 0.5
    b = q[FIELDS[axis]]
    return sqrt(half + sqrt(greatest(half * half - c2 * b * b / q["r"], 0.0)))


def alfven_speed(q, axis: int = 0):
    return absolute(q[FIELDS[axis]]) / sqrt(q["r"])


def info_speed(q, axis: int = 0, gamma: float = 1.4):
    return fast_speed(q, axis, gamma) + absolute(q[VELOCITIES[axis]])


def mhd_conservative(q, gamma: float = 1.4):
    out = {"r": q["r"], "e": q["p"] / (gamma - 1) + kinetic(q) + magnetic_pressure(q)}
    return out | {k: q["r"] * q[k] for k in VELOCITIES} | {k: q[k] for k in FIELDS}


def mhd_flux(q, gamma: float = 1.4):
    total = q["p"] + magnetic_pressure(q)
    mass = q["r"] * q["u"]
    along = q["u"] * q["bx"] + q["v"] * q["by"] + q["w"] * q["bz"]
    return {
        "r": mass,
        "e": (mhd_conservative(q, gamma)["e"] + total) * q["u"] - q["bx"] * along,
        "u": mass * q["u"] + total - q["bx"] * q["bx"],
        "v": mass * q["v"] - q["bx"] * q["by"],
        "w": mass * q["w"] - q["bx"] * q["bz"],
        "bx": q["bx"] * 0.0,
        "by": q["by"] * q["u"] - q["bx"] * q["v"],
        "bz": q["bz"] * q["u"] - q["bx"] * q["w"],
    }


def _one_normal_field(P, left, right):
    b = P.let((left["bx"] + right["bx"]) * 0.5)
    return left | {"bx": b}, right | {"bx": b}


def mhd_llf(P, left, right, gamma: float = 1.4):
    a, b = _one_normal_field(P, left, right)
    speed = P.let(greatest(info_speed(a, 0, gamma), info_speed(b, 0, gamma)))
    ul, ur, fl, fr = mhd_conservative(a, gamma), mhd_conservative(b, gamma), mhd_flux(a, gamma), mhd_flux(b, gamma)
    return {k: P.let((fl[k] + fr[k]) * 0.5 - speed * (ur[k] - ul[k]) * 0.5) for k in fl}


def mhd_hll(P, left, right, gamma: float = 1.4):
    a, b = _one_normal_field(P, left, right)
    fa, fb = P.let(fast_speed(a, 0, gamma)), P.let(fast_speed(b, 0, gamma))
    low, high = P.let(least(least(a["u"], b["u"]) - greatest(fa, fb), 0.0)), P.let(greatest(greatest(a["u"], b["u"]) + greatest(fa, fb), 0.0))
    ul, ur, fl, fr = mhd_conservative(a, gamma), mhd_conservative(b, gamma), mhd_flux(a, gamma), mhd_flux(b, gamma)
    return {k: P.let((high * fl[k] - low * fr[k] + low * high * (ur[k] - ul[k])) / (high - low)) for k in fl}


def mhd_hlld(P, left, right, gamma: float = 1.4):
    """Five waves (Miyoshi and Kusano 2005): fast, Alfven and contact on both sides."""
    a, b = _one_normal_field(P, left, right)
    bn, sgn = a["bx"], P.let(sign(a["bx"]))
    fa, fb = P.let(fast_speed(a, 0, gamma)), P.let(fast_speed(b, 0, gamma))
    low, high = P.let(least(a["u"], b["u"]) - greatest(fa, fb)), P.let(greatest(a["u"], b["u"]) + greatest(fa, fb))
    pa, pb = P.let(a["p"] + magnetic_pressure(a)), P.let(b["p"] + magnetic_pressure(b))
    ml, mr = P.let(a["r"] * (a["u"] - low)), P.let(b["r"] * (high - b["u"]))
    u = P.let((mr * b["u"] + ml * a["u"] + (pa - pb)) / (mr + ml))
    p = P.let((mr * pa + ml * pb + ml * mr * (a["u"] - b["u"])) / (mr + ml))

    def first(q, s, pt):
        """The state behind the fast wave."""
        d = q["r"] * (s - q["u"]) * (s - u) - bn * bn
        flat = P.let(absolute(d) < absolute(bn * bn) * 1e-4 + 1e-300)
        d = P.let(where(flat, 1.0, d))
        r = P.let(q["r"] * (s - q["u"]) / (s - u))
        turn = P.let(where(flat, 0.0, bn * (q["u"] - u) / d))
        grow = P.let(where(flat, 1.0, (q["r"] * (s - q["u"]) * (s - q["u"]) - bn * bn) / d))
        out = {"r": r, "u": u, "bx": bn, "v": P.let(q["v"] + q["by"] * turn), "w": P.let(q["w"] + q["bz"] * turn), "by": P.let(q["by"] * grow), "bz": P.let(q["bz"] * grow)}
        dot = lambda x: x["u"] * bn + x["v"] * x["by"] + x["w"] * x["bz"]
        e = P.let(mhd_conservative(q, gamma)["e"])
        out["e"] = P.let(((s - q["u"]) * e - pt * q["u"] + p * u + bn * (dot(q) - dot(out))) / (s - u))
        return out

    x, y = first(a, low, pa), first(b, high, pb)
    rx, ry = P.let(sqrt(x["r"])), P.let(sqrt(y["r"]))
    sl, sr = P.let(u - absolute(bn) / rx), P.let(u + absolute(bn) / ry)
    inner = {}
    for k, f in (("v", "by"), ("w", "bz")):
        inner[k] = P.let((rx * x[k] + ry * y[k] + (y[f] - x[f]) * sgn) / (rx + ry))
        inner[f] = P.let((rx * y[f] + ry * x[f] + rx * ry * (y[k] - x[k]) * sgn) / (rx + ry))
    dot2 = P.let(u * bn + inner["v"] * inner["by"] + inner["w"] * inner["bz"])
    dot1 = lambda q: u * bn + q["v"] * q["by"] + q["w"] * q["bz"]
    el, er = P.let(x["e"] - rx * (dot1(x) - dot2) * sgn), P.let(y["e"] + ry * (dot1(y) - dot2) * sgn)
    pick = lambda six: P.let(where(low > 0, six[0], where(sl > 0, six[1], where(u > 0, six[2], where(sr > 0, six[3], where(high > 0, six[4], six[5]))))))
    ea, eb = mhd_conservative(a, gamma)["e"], mhd_conservative(b, gamma)["e"]
    r = pick([a["r"], x["r"], x["r"], y["r"], y["r"], b["r"]])
    s = {"u": pick([a["u"], u, u, u, u, b["u"]])} | {k: pick([a[k], x[k], inner[k], inner[k], y[k], b[k]]) for k in ("v", "w", "by", "bz")}
    e, t = pick([ea, x["e"], el, er, y["e"], eb]), pick([pa, p, p, p, p, pb])
    out = {"r": r * s["u"], "u": r * s["u"] * s["u"] + t - bn * bn, "v": r * s["u"] * s["v"] - bn * s["by"], "w": r * s["u"] * s["w"] - bn * s["bz"]}
    out |= {"bx": bn * 0.0, "by": s["by"] * s["u"] - bn * s["v"], "bz": s["bz"] * s["u"] - bn * s["w"], "e": (e + t) * s["u"] - bn * (s["u"] * bn + s["v"] * s["by"] + s["w"] * s["bz"])}
    return {k: P.let(f) for k, f in out.items()}


def edge_emf_llf(P, corners, gamma: float = 1.4):
    """Electromotive force at an edge from its four states (by x side, then y side): mean minus the jumps of the fields at the fastest speed."""
    emf = lambda q: q["u"] * q["by"] - q["v"] * q["bx"]
    ll, rl, lr, rr = corners
    mean = (emf(ll) + emf(rl) + emf(lr) + emf(rr)) * 0.25
    sx = P.let(greatest(*[info_speed(q, 0, gamma) for q in corners]))
    sy = P.let(greatest(*[info_speed(q, 1, gamma) for q in corners]))
    return P.let(mean - sx * ((rl["by"] + rr["by"]) - (ll["by"] + lr["by"])) * 0.25 + sy * ((lr["bx"] + rr["bx"]) - (ll["bx"] + rl["bx"])) * 0.25)


# Time integration and sweeps

#: Stages as (weight of the start, weight of the last stage plus its step).
INTEGRATORS = {"rk1": [(0.0, 1.0)], "hancock": [(0.0, 1.0)], "rk2_ssp": [(0.0, 1.0), (0.5, 0.5)], "rk3_ssp": [(0.0, 1.0), (0.75, 0.25), (1.0 / 3.0, 2.0 / 3.0)]}


def advanced(P, value, rate, dt: float, kind: str = "rk3_ssp"):
    """One step of du/dt = rate(u)."""
    now = value
    for first, last in INTEGRATORS[kind]:
        now = P.let(value * first + (now + rate(now) * dt) * last)
    return now


# The orders of axes that a permuting schedule goes through, and the weights of the third-order splitting.
PHASES = {1: ("x",), 2: ("xy", "yx"), 3: ("xyz", "zyx", "yzx", "xzy", "zxy", "yxz")}
RUTH = ((7 / 24, 2 / 3), (3 / 4, -2 / 3), (-1 / 24, 1.0))


def schedule(kind: str, dim: int) -> list[list[tuple[int, float]]]:
    """Phases of a splitting by axes: each a list of (axis, share of the time step).

    none: one phase, all axes in order. permutation: an order of axes each. ruth_order3: third order; in three dimensions the first two axes are
    split within each outer step of the third.
    """
    from itertools import permutations

    if kind == "none":
        return [[(d, 1.0) for d in range(dim)]]
    if kind == "permutation":
        return [[("xyz".index(a), 1.0) for a in phase] for phase in PHASES[dim]]
    if kind == "ruth_order3":
        if dim == 2:
            return [[(axis, share) for pair in RUTH for axis, share in zip(order, pair, strict=True)] for order in permutations(range(2))]
        return [[step for outer, last in RUTH for step in [*((axis, outer * share) for pair in RUTH for axis, share in zip(order[:2], pair, strict=True)), (order[2], last)]] for order in permutations(range(3))]
    raise ValueError(f"unknown schedule {kind!r}")


def sweeps(kind: str, dim: int, iteration: int) -> list[int]:
    """The axes to sweep in a step."""
    phases = schedule(kind, dim)
    return [axis for axis, _ in phases[iteration % len(phases)]]
