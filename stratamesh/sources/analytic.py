"""Analytic fields and initial states at cell centres."""

from __future__ import annotations

import math

from ..functions.algebra import cos, exp, sin, where


def gaussian(coords, centre, sigma: float = 0.1):
    r2 = sum(((c - o) * (c - o) for c, o in zip(coords[1:], centre[1:], strict=True)), (coords[0] - centre[0]) * (coords[0] - centre[0]))
    return exp(r2 * (-1.0 / (2 * sigma * sigma))) * (1.0 / (sigma * math.sqrt(2 * math.pi)))


def hat(coords, centre, radius: float):
    r2 = sum(((c - o) * (c - o) for c, o in zip(coords[1:], centre[1:], strict=True)), (coords[0] - centre[0]) * (coords[0] - centre[0]))
    return where(r2 < radius * radius, 1.0, 0.0)


def parabola(coords):
    """3 x^2 + y^2 [+ z^2 / 2]; its Laplacian is 8 or 9."""
    out = coords[0] * coords[0] * 3.0 + coords[1] * coords[1]
    return out + coords[2] * coords[2] * 0.5 if len(coords) == 3 else out


def sine_wave(coords, k: float = 1.0):
    total = coords[0] + coords[1] if len(coords) == 2 else coords[0] + coords[1] + coords[2]
    return sin(total * (2 * math.pi * k))


def ramp(coords, var: int = 0):
    return coords[0] + coords[1] + float(var)


def squared_cosine(coords, var: int = 0):
    c = cos((coords[0] + coords[1]) * (2 * math.pi))
    return c * c + float(var)


def difference(coords, var: int = 0):
    return coords[0] - coords[1] + float(var)


def sod(x, middle: float = 0.5):
    """Sod's shock tube: density, velocity, pressure."""
    left = x < middle
    return where(left, 1.0, 0.125), x * 0.0, where(left, 1.0, 0.1)


def quadrants(coords, states, middle=(0.5, 0.5)):
    """Four states (rho, u, v, p) of a two-dimensional Riemann problem, counted counter-clockwise from the upper right."""
    right, up = coords[0] >= middle[0], coords[1] >= middle[1]
    return [where(right, where(up, a, d), where(up, b, c)) for a, b, c, d in zip(*states, strict=True)]
