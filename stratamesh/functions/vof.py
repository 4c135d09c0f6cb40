"""Interface geometry in unit boxes: volumes below planes, planes for volumes, interface normals, advected shares."""

from __future__ import annotations

from .algebra import absolute, acos, cos, greatest, least, power, sqrt, where

TINY = 1e-12


def clamp(x, low: float = 0.0, high: float = 1.0):
    return least(greatest(x, low), high)


def area_below(P, normal, alpha):
    """Part of the centred unit square where n . x < alpha."""
    nx, ny = (P.let(absolute(n)) for n in normal)
    a = P.let(alpha + (nx + ny) / 2.0)
    small, big = P.let(least(nx, ny)), P.let(greatest(nx, ny))
    both = P.let(where(nx * ny > 0, nx * ny * 2.0, 1.0))
    rest = P.let(nx + ny - a)
    inside = where(a <= small, a * a / both, where(a <= big, (a - small * 0.5) / where(big > 0, big, 1.0), 1.0 - rest * rest / both))
    return P.let(clamp(where(a <= 0, 0.0, where(rest <= 0, 1.0, inside))))


def volume_below(P, normal, alpha):
    """Part of the centred unit cube where n . x < alpha: a sum of cubes over the corners below the plane, for any signs."""
    parts = [P.let(absolute(n)) for n in normal]
    total = P.let(parts[0] + parts[1] + parts[2])
    safe = P.let(where(total > TINY, total, 1.0))
    unit = [P.let(p / safe) for p in parts]
    a = P.let(clamp((alpha + total / 2.0) / safe))
    low = P.let(least(a, 1.0 - a))
    b1, b3 = P.let(least(*unit)), P.let(greatest(*unit))
    b2 = P.let(unit[0] + unit[1] + unit[2] - b1 - b3)
    pr = P.let(greatest(b1 * b2 * b3 * 6.0, 1e-50))
    cube = lambda x: where(x > 0, x * x * x, 0.0)
    corner = (low * low * low - cube(low - b1) - cube(low - b2) - cube(low - b3)) / pr
    near = low * (low - b1) * 0.5 / where(b2 * b3 > 0, b2 * b3, 1.0) + b1 * b1 * b1 / pr
    slab = (low - (b1 + b2) * 0.5) / where(b3 > 0, b3, 1.0)
    part = P.let(where(low < b1, low * low * low / pr, where(low < b2, near, where(low >= b1 + b2, where(b1 + b2 < b3, slab, corner), corner))))
    return P.let(where(alpha + total / 2.0 <= 0, 0.0, where(alpha >= total / 2.0, 1.0, clamp(where(a <= 0.5, part, 1.0 - part)))))


def box_below(P, normal, alpha, low, high):
    """The same for any box."""
    for n, a, b in zip(normal, low, high, strict=True):
        alpha = alpha - n * ((a + b) * 0.5)
    scaled = [n * (b - a) for n, a, b in zip(normal, low, high, strict=True)]
    below = area_below if len(normal) == 2 else volume_below
    return below(P, [P.let(n) for n in scaled], P.let(alpha))


def line_for_area(P, normal, area):
    """The inverse of ``area_below`` for 0 < area < 1: closed form."""
    nx, ny = (P.let(absolute(n)) for n in normal)
    small, big = P.let(least(nx, ny)), P.let(greatest(nx, ny))
    part = P.let(where(area > 0.5, 1.0 - area, area))
    low = P.let(where(nx * ny * part * 2.0 < small * small, sqrt(nx * ny * part * 2.0), small * 0.5 + big * part) - (nx + ny) / 2.0)
    return P.let(where(area > 0.5, -low, low))


def plane_for_volume(P, normal, volume):
    """The inverse of ``volume_below`` for 0 < volume < 1, in closed form: in the smaller part the plane cuts off a tetrahedron, then takes on one and two corners more, or becomes a slab.

    The cubic equations are solved by angles (Scardovelli and Zaleski, Journal of Computational Physics 164, 2000).
    """
    parts = [P.let(absolute(n)) for n in normal]
    total = P.let(parts[0] + parts[1] + parts[2])
    unit = [P.let(p / where(total > TINY, total, 1.0)) for p in parts]
    b1, b3 = P.let(least(*unit)), P.let(greatest(*unit))
    b2 = P.let(unit[0] + unit[1] + unit[2] - b1 - b3)
    part, both, six = P.let(where(volume > 0.5, 1.0 - volume, volume)), P.let(b1 + b2), P.let(b1 * b2 * b3 * 6.0)
    first = P.let(where(b2 * b3 > TINY, b1 * b1 / greatest(b2 * b3 * 6.0, TINY), 0.0))  # volume up to the nearest corner
    second = P.let(first + (b2 - b1) * 0.5 / greatest(b3, TINY))
    third = P.let(where(both < b3, both * 0.5 / greatest(b3, TINY), where(six > TINY, (b3 * b3 * (both * 3.0 - b3) + b1 * b1 * (b1 - b3 * 3.0) + b2 * b2 * (b2 - b3 * 3.0)) / greatest(six, TINY), second)))

    def by_angle(p, q):
        """sqrt(p) (sqrt(3) sin t - cos t) with cos 3t = q."""
        c = P.let(cos(acos(clamp(q, -1.0, 1.0)) / 3.0))
        return P.let(p * (sqrt(greatest(1.0 - c * c, 0.0) * 3.0) - c))

    p12 = P.let(sqrt(b1 * b2 * 2.0))
    two = by_angle(p12, (both - b3 * part * 2.0) * 3.0 / greatest(p12 * 4.0, TINY)) + both
    p3 = P.let(greatest(b1 * both + b2 * b3 + b1 * b3 - b1 * b1 - 0.25, TINY))
    three = by_angle(P.let(sqrt(p3)), b1 * b2 * b3 * (0.5 - part) * 1.5 / (p3 * sqrt(p3))) + 0.5
    below = where(part < first, power(six * part, 1.0 / 3.0), where(part < second, (b1 + sqrt(greatest(b1 * b1 + b2 * b3 * (part - first) * 8.0, 0.0))) * 0.5, where(part < third, two, where(both < b3, b3 * part + both * 0.5, three))))
    low = P.let(where(total > TINY, below * total - total * 0.5, 0.0))
    return P.let(where(volume > 0.5, -low, low))


def youngs(P, f, sizes):
    """Unit normal from 9 or 27 neighbouring fractions (x fastest), pointing out of the fluid; zero where there is no slope."""
    dim = len(sizes)
    weights = (1.0, 2.0, 1.0)
    total = 4.0 ** (dim - 1)
    slopes = []
    for d in range(dim):
        terms = None
        for i, value in enumerate(f):
            at = [i // 3**k % 3 for k in range(dim)]
            if at[d] == 1:
                continue
            w = 1.0
            for k in range(dim):
                w *= weights[at[k]] if k != d else 1.0
            term = value * (w / total * (-1.0 if at[d] == 2 else 1.0))
            terms = term if terms is None else terms + term
        slopes.append(P.let(terms / (2.0 * sizes[d])))
    norm = P.let(sqrt(sum((s * s for s in slopes[1:]), slopes[0] * slopes[0])))
    none = norm < TINY
    unit = [P.let(where(none, 0.0, s / where(none, 1.0, norm))) for s in slopes]
    axis = None
    for u in unit:
        close = absolute(u) > 1.0 - TINY
        axis = close if axis is None else axis | close
    return [P.let(where(axis, where(absolute(u) > 1.0 - TINY, where(u >= 0, 1.0, -1.0), 0.0), where(absolute(u) < TINY, 0.0, u))) for u in unit]


def advected(P, alpha, plane, normal, sizes, axis: int, right: bool, share):
    """Fraction of the volume swept through a face that is fluid; ``share`` is the swept part of the cell."""
    dim = len(normal)
    low, high = [0.0] * dim, list(sizes)
    low[axis] = (1.0 - share) * sizes[axis] if right else 0.0
    high[axis] = sizes[axis] if right else share * sizes[axis]
    cut = box_below(P, normal, plane, low, high)
    gap = P.let((1.0 - power(alpha, 1.0 / dim)) * 0.5)
    core = 1.0 - gap * 2.0
    bubble = where(share < gap, 0.0, where(1.0 - share < gap, alpha / share, (core if dim == 2 else core * core) * (share - gap) / share))
    flat = None
    for n in normal:
        zero = absolute(n) < TINY
        flat = zero if flat is None else flat & zero
    return P.let(where((share < TINY) | (alpha < TINY), 0.0, where(flat, bubble, cut)))
