"""More solvers of magnetohydrodynamics: gas-only HLLC, relaxation with five waves, HLLD with a bounded Alfven speed, and the two-dimensional
solver for the electromotive force at edges. States and programs are those of flux."""

from __future__ import annotations

from .algebra import absolute, greatest, least, sign, sqrt, where
from .eos import IdealGas
from .flux import FIELDS, VELOCITIES, fast_speed, hllc, kinetic, magnetic_pressure, mhd_conservative, mhd_hll, mhd_hlld, mhd_llf

GAS = ("r", *VELOCITIES, "p")


def mhd_hllc(P, left, right, gamma: float = 1.4):
    """Three waves of the gas alone: the field has no part in it, and its fluxes are zero."""
    out = hllc(P, {k: left[k] for k in GAS}, {k: right[k] for k in GAS}, IdealGas(gamma))
    return out | {k: left[k] * 0.0 for k in FIELDS}


def five_waves(P, left, right, gamma: float = 1.4, induction=None):
    """Relaxation along each axis with its own impedance; the contact carries the upwind state, and its field is stretched by the normal field of the other side.

    ``induction``: a condition of (left, right, kinetic and magnetic energies) under which the stretching stays; always, where None.
    """
    sides = []
    for q in (left, right):
        magnetic = P.let(magnetic_pressure(q))
        shear = P.let(sqrt(q["r"] * (q["bx"] * q["bx"] + magnetic)) + 1e-14)
        normal = P.let(sqrt(q["r"] * (q["p"] * gamma + q["by"] * q["by"] + q["bz"] * q["bz"] + magnetic)))
        push = [P.let(q["p"] + magnetic - q["bx"] * q["bx"]), P.let(-q["bx"] * q["by"]), P.let(-q["bx"] * q["bz"])]
        moving = P.let(kinetic(q))
        sides.append((q, [normal, shear, shear], push, moving, magnetic, P.let(q["p"] / (gamma - 1) + moving + magnetic)))
    (a, za, pa, ka, ma, ea), (b, zb, pb, kb, mb, eb) = sides
    speed = [P.let((za[i] * a[k] + zb[i] * b[k] + pa[i] - pb[i]) / (za[i] + zb[i])) for i, k in enumerate(VELOCITIES)]
    force = [P.let((zb[i] * pa[i] + za[i] * pb[i] + za[i] * zb[i] * (a[k] - b[k])) / (za[i] + zb[i])) for i, k in enumerate(VELOCITIES)]
    upwind = lambda x, y: P.let(where(speed[0] > 0, x, y))
    mass = P.let(upwind(a["r"], b["r"]) * speed[0])
    against = upwind(b["bx"], a["bx"])
    if induction is not None:
        against = P.let(where(induction(a, b, (ka, kb), (ma, mb)), against, 0.0))
    out = {"r": mass, "e": P.let(upwind(ea, eb) * speed[0] + speed[0] * force[0] + speed[1] * force[1] + speed[2] * force[2])}
    for i, (k, f) in enumerate(zip(VELOCITIES, FIELDS, strict=True)):
        out[k] = P.let(mass * upwind(a[k], b[k]) + force[i])
        out[f] = P.let(upwind(a[f], b[f]) * speed[0] - against * speed[i])
    return out


def five_waves_entropy(P, left, right, gamma: float = 1.4, small_beta: float = 1e-3, large_alfven: float = 10.0):
    """Five waves that drop the stretching of the field where the gas pressure is small beside the magnetic one, or the flow fast beside Alfven waves."""

    def calm(a, b, moving, magnetic):
        thick = (a["p"] >= magnetic[0] * small_beta) & (b["p"] >= magnetic[1] * small_beta)
        fast = large_alfven * large_alfven
        return thick & (moving[0] <= magnetic[0] * fast) & (moving[1] <= magnetic[1] * fast)

    return five_waves(P, left, right, gamma, calm)


def boris_factor(q, limit: float = 1.0):
    """Square of the factor that keeps Alfven waves below ``limit``."""
    return 1.0 / (magnetic_pressure(q) * 2.0 / q["r"] / (limit * limit) + 1.0)


def boris_fast_speed(q, axis: int = 0, gamma: float = 1.4, limit: float = 1.0):
    c2 = q["p"] * gamma / q["r"]
    half = (magnetic_pressure(q) * 2.0 / q["r"] + c2) * 0.5
    b = q[FIELDS[axis]]
    return sqrt(boris_factor(q, limit) * half + sqrt(greatest(half * half - c2 * b * b / q["r"], 0.0)))


def boris_info_speed(q, axis: int = 0, gamma: float = 1.4, limit: float = 1.0):
    return boris_fast_speed(q, axis, gamma, limit) + absolute(q[VELOCITIES[axis]])


def mhd_hlld_boris(P, left, right, gamma: float = 1.4, limit: float = 1.0):
    """HLLD with the Boris correction (Matsumoto, Miyoshi and Takasao 2019): inertia grows by the inverse factor of each side."""
    bn = P.let((left["bx"] + right["bx"]) * 0.5)
    b2, sgn, size = P.let(bn * bn), P.let(sign(bn)), P.let(absolute(bn))
    sides = []
    for q in (left, right):
        q = q | {"bx": bn}
        g = P.let(boris_factor(q, limit))
        q = q | {"g": g, "fast": P.let(boris_fast_speed(q, 0, gamma, limit))} | {k: P.let(q[k] * g) for k in VELOCITIES}
        sides.append(q | {"pt": P.let(q["p"] + magnetic_pressure(q)), "e": P.let(mhd_conservative(q, gamma)["e"]), "vb": P.let(q["u"] * bn + q["v"] * q["by"] + q["w"] * q["bz"])})
    a, b = sides
    low, high = P.let(least(a["u"], b["u"]) - greatest(a["fast"], b["fast"])), P.let(greatest(a["u"], b["u"]) + greatest(a["fast"], b["fast"]))
    average = lambda xa, fa, xb, fb: P.let((high * xb - low * xa - fb + fa) / (high - low))
    r = average(a["r"], a["r"] * a["u"], b["r"], b["r"] * b["u"])
    by, bz = (average(a[f], a["u"] * a[f] - a[k] * bn, b[f], b["u"] * b[f] - b[k] * bn) for k, f in (("v", "by"), ("w", "bz")))
    g = P.let(1.0 / ((b2 + by * by + bz * bz) / r / (limit * limit) + 1.0))
    thrust = lambda q, s: q["r"] * q["u"] * (s / q["g"] - q["u"]) - q["pt"]
    u = P.let((thrust(b, high) - thrust(a, low)) * g / ((high - b["u"]) * b["r"] - (low - a["u"]) * a["r"]))

    def first(q, s):
        """The state behind the fast wave."""
        gap, wave = P.let((s - q["u"]) / (s - u)), P.let(s / q["g"])
        inertia = P.let(q["r"] * (s - q["u"]) * (wave - u) - b2)
        drag = P.let(q["r"] * (wave - q["u"]) * (s - u) - b2)
        flat = P.let((absolute(inertia) < b2 * 1e-4) | (inertia == 0.0))
        inertia = P.let(where(flat, 1.0, inertia))
        grow = P.let(where(flat, 1.0, (q["r"] * (s - q["u"]) * gap * (wave - u) - b2) / inertia))
        keep, turn = P.let(where(flat, 1.0, drag / inertia)), P.let(where(flat, 0.0, bn * (q["u"] - u) / inertia))
        out = {"r": P.let(q["r"] * gap), "u": u, "pt": P.let(thrust(q, s) * -1.0 + (wave - u) * q["r"] * u * gap)}
        for k, f in (("v", "by"), ("w", "bz")):
            out[k] = P.let(q[k] * keep + q[f] * turn)
            out[f] = P.let(q[f] * grow + (1.0 - keep) * q[k] * bn / (s - u))
        out["vb"] = P.let(u * bn + out["v"] * out["by"] + out["w"] * out["bz"])
        out["e"] = P.let(((s - q["u"]) * q["e"] - q["pt"] * q["u"] + out["pt"] * u + bn * (q["vb"] - out["vb"])) / (s - u))
        return out | {"root": P.let(sqrt(out["r"] / q["g"])), "extra": P.let((1.0 - 1.0 / q["g"]) * u * out["r"] / where(size > 0, size, 1.0))}

    x, y = first(a, low), first(b, high)
    sl, sr = P.let(u - size * sqrt(a["g"] / x["r"])), P.let(u + size * sqrt(b["g"] / y["r"]))
    xg, yg, both = P.let(sqrt(b["g"] * x["r"])), P.let(sqrt(a["g"] * y["r"])), P.let(sqrt(x["r"] * y["r"]))
    inner = {"u": u}
    for k, f in (("v", "by"), ("w", "bz")):
        inner[k] = P.let((x["root"] * x[k] + y["root"] * y[k] + sgn * (y[f] - x[f]) + x["extra"] * x[k] - y["extra"] * y[k]) / (x["root"] + y["root"]))
        inner[f] = P.let((xg * y[f] + yg * x[f] + both * (y[k] - x[k]) * sgn) / (xg + yg))
    inner["vb"] = P.let(u * bn + inner["v"] * inner["by"] + inner["w"] * inner["bz"])
    xx = x | inner | {"e": P.let(x["e"] - sgn * x["root"] * (x["vb"] - inner["vb"]))}
    yy = y | inner | {"e": P.let(y["e"] + sgn * y["root"] * (y["vb"] - inner["vb"]))}
    pick = lambda k: P.let(where(low > 0, a[k], where(sl > 0, x[k], where(u > 0, xx[k], where(sr > 0, yy[k], where(high > 0, y[k], b[k]))))))
    s = {k: pick(k) for k in ("r", "u", "v", "w", "by", "bz", "pt", "e", "vb")}
    mass = P.let(s["r"] * s["u"])
    out = {"r": mass, "e": (s["e"] + s["pt"]) * s["u"] - bn * s["vb"], "u": mass * s["u"] - b2 + s["pt"], "v": mass * s["v"] - bn * s["by"], "w": mass * s["w"] - bn * s["bz"]}
    out |= {"bx": bn * 0.0, "by": s["by"] * s["u"] - bn * s["v"], "bz": s["bz"] * s["u"] - bn * s["w"]}
    return {k: P.let(f) for k, f in out.items()}


MHD_SOLVERS = {"llf": mhd_llf, "hll": mhd_hll, "hllc": mhd_hllc, "hlld": mhd_hlld, "five_waves": five_waves, "five_waves_entropy": five_waves_entropy, "hlld_boris": mhd_hlld_boris}


def solve_mhd(kind: str, P, left, right, **options):
    """The solver of a configuration's name."""
    if kind not in MHD_SOLVERS:
        raise ValueError(f"unknown magnetic Riemann solver {kind!r}; known: {', '.join(MHD_SOLVERS)}")
    return MHD_SOLVERS[kind](P, left, right, **options)


def edge_states(corners, axis: int):
    """The four states around an edge along ``axis`` (low-low, high-low, low-high, high-high), turned so that the edge is the z axis; fields along the two other axes are those of the faces between two states."""
    first, second = (axis + 1) % 3, (axis + 2) % 3
    turned = []
    for q in corners:
        turned.append({"r": q["r"], "p": q["p"]} | {new: q[old[i]] for old in (VELOCITIES, FIELDS) for new, i in zip(old, (first, second, axis), strict=True)})
    for f, pairs in (("bx", ((0, 1), (2, 3))), ("by", ((0, 2), (1, 3)))):
        for i, j in pairs:
            turned[i][f] = turned[j][f] = (turned[i][f] + turned[j][f]) * 0.5
    return turned


def edge_emf_hlld(P, corners, gamma: float = 1.4, floor: float = 1e-8):
    """Electromotive force at an edge along z from its four states (low-low, high-low, low-high, high-high): fast and Alfven waves along x and y,
    compressions by both contacts, and the states that the edge lies in."""
    names = ("ll", "hl", "lh", "hh")
    q = {n: {k: P.let(c[k]) for k in ("r", "u", "v", "p", *FIELDS)} for n, c in zip(names, corners, strict=True)}
    total = {n: P.let(s["p"] + magnetic_pressure(s)) for n, s in q.items()}

    def fan(place: int):
        """Outer speeds and contact along x (place 0) or y (place 1)."""
        k = VELOCITIES[place]
        fast = P.let(greatest(*[fast_speed(s, place, gamma) for s in q.values()]))
        low, high = P.let(least(*[s[k] for s in q.values()]) - fast), P.let(greatest(*[s[k] for s in q.values()]) + fast)
        weight = {n: P.let(s["r"] * (s[k] - low if n[place] == "l" else high - s[k])) for n, s in q.items()}
        moved = sum((weight[n] * q[n][k] + (total[n] if n[place] == "l" else -total[n]) for n in names[1:]), weight["ll"] * q["ll"][k] + total["ll"])
        star = P.let(moved / sum((weight[n] for n in names[1:]), weight["ll"]))
        return low, high, star, {n: P.let(((low if n[place] == "l" else high) - s[k]) / ((low if n[place] == "l" else high) - star)) for n, s in q.items()}

    west, east, u, tight_x = fan(0)
    south, north, v, tight_y = fan(1)
    by = {n: P.let(s["by"] * tight_x[n]) for n, s in q.items()}
    bx = {n: P.let(s["bx"] * tight_y[n]) for n, s in q.items()}

    def alfven(place: int, side: str):
        field, star, tight = (("bx", bx, tight_x), ("by", by, tight_y))[place]
        found = [floor]
        for n in names:
            if n[place] == side:
                s = q[n]
                found += [absolute(s[field]) / sqrt(s["r"] * tight[n]), absolute(star[n]) / sqrt(s["r"] * tight_x[n] * tight_y[n])]
        return P.let(greatest(*found[1:], found[0]))

    w, e = P.let(least(u - alfven(0, "l"), 0.0)), P.let(greatest(u + alfven(0, "h"), 0.0))
    s, n = P.let(least(v - alfven(1, "l"), 0.0)), P.let(greatest(v + alfven(1, "h"), 0.0))
    plain = {c: P.let(x["u"] * x["by"] - x["v"] * x["bx"]) for c, x in q.items()}
    in_x = {c: P.let(u * by[c] - x["v"] * x["bx"]) for c, x in q.items()}
    in_y = {c: P.let(x["u"] * x["by"] - v * bx[c]) for c, x in q.items()}
    inside = {c: P.let(u * by[c] - v * bx[c]) for c in names}
    mean_x = lambda x, y: (e * x - w * y) / (e - w)
    mean_y = lambda x, y: (n * x - s * y) / (n - s)

    def row(side: str):
        """Beyond the fan along y."""
        a, b = "l" + side, "h" + side
        return P.let(where(west >= 0, plain[a], where(east < 0, plain[b], mean_x(in_x[a], in_x[b]) + e * w * (q[b]["by"] - q[a]["by"]) / (e - w))))

    def column(side: str):
        """Beyond the fan along x."""
        a, b = side + "l", side + "h"
        return P.let(mean_y(in_y[a], in_y[b]) - n * s * (q[b]["bx"] - q[a]["bx"]) / (n - s))

    top_less_bottom = P.let((e * (bx["hh"] - bx["hl"]) - w * (bx["lh"] - bx["ll"])) / (e - w))
    right_less_left = P.let((n * (by["hh"] - by["lh"]) - s * (by["hl"] - by["ll"])) / (n - s))
    centre = P.let(mean_y(mean_x(inside["ll"], inside["hl"]), mean_x(inside["lh"], inside["hh"])) - n * s / (n - s) * top_less_bottom + e * w / (e - w) * right_less_left)
    return P.let(where(south >= 0, row("l"), where(north < 0, row("h"), where(west >= 0, column("l"), where(east < 0, column("h"), centre)))))
