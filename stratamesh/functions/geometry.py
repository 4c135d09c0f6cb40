"""From keys to coordinates, lengths and named maps."""

from __future__ import annotations

import math

from . import keys as K
from .algebra import absolute, cos, double, sin, sqrt, tan, where


def vertex(key, dim: int = 2, centred: bool = False):
    """Corner (or centre) of an octant in units of trees."""
    root = K.LAYOUTS[dim].root
    half = double(K.length(key, dim)) / 2 if centred else 0.0
    return [double(t) + (double(c) + half) / root for t, c in zip(K.tree_coords(key, dim), K.octant_coords(key, dim), strict=True)]


def outside_vertex(key, brick, dim: int = 2, centred: bool = False):
    """The same for keys beyond the domain: their wrapped coordinate is moved past the border it left through."""
    inside = vertex(key, dim, centred)
    return [where(K.is_outside_along(key, d, dim), where(v < brick[d] / 2, v + brick[d], v - brick[d]), v) for d, v in enumerate(inside)]


def _placed(key, offsets, sizes, dim: int):
    root = K.LAYOUTS[dim].root
    size = double(K.length(key, dim)) / root
    return [v + size * o / n for v, o, n in zip(vertex(key, dim), offsets, sizes, strict=True)]


def cell_centre(key, ijk, sizes, dim: int = 2):
    return _placed(key, [double(c) + 0.5 for c in ijk], sizes, dim)


def corner(key, ijk, sizes, which: int, dim: int = 2):
    return _placed(key, [double(c) + float(which >> d & 1) for d, c in enumerate(ijk)], sizes, dim)


def face_centre(key, ijk, axis: int, sizes, dim: int = 2):
    """The centre of the lower face along an axis."""
    return _placed(key, [double(c) + (0.0 if d == axis else 0.5) for d, c in enumerate(ijk)], sizes, dim)


def edge_centre(key, ijk, axis: int, sizes, dim: int = 3):
    """The centre of the lower edge parallel to an axis."""
    return _placed(key, [double(c) + (0.5 if d == axis else 0.0) for d, c in enumerate(ijk)], sizes, dim)


def real_space(coords, low, scale: float):
    return [v * scale + x for v, x in zip(coords, low, strict=True)]


def cell_length(lev, size: int, dim: int = 2, scale: float = 1.0):
    return double(K.length_of_level(lev, dim)) / K.LAYOUTS[dim].root / size * scale


def block_length(lev, dim: int = 2, scale: float = 1.0):
    return double(K.length_of_level(lev, dim)) / K.LAYOUTS[dim].root * scale


def tangent(point, centre, radius):
    """Normal and right-hand side of the tangent plane of a sphere at the foot of a point: n . x = alpha."""
    d = [p - o for p, o in zip(point, centre, strict=True)]
    norm = sqrt(sum((x * x for x in d[1:]), d[0] * d[0]))
    n = [x / norm for x in d]
    alpha = sum((a * o for a, o in zip(n[1:], centre[1:], strict=True)), n[0] * centre[0]) + radius
    return n, alpha


# Named maps of the unit brick


def polar(coords, inner: float, outer: float):
    """Ring: first coordinate the radius, second the angle in turns."""
    r = coords[0] * (outer - inner) + inner
    return [r * cos(coords[1] * (2 * math.pi)), r * sin(coords[1] * (2 * math.pi)), *coords[2:]]


def cube_to_shell(coords, inner: float, outer: float):
    """One of six caps of a shell: two face coordinates in -1..1 and the radius share; equal angles by tangents."""
    a, b = tan(coords[0] * (math.pi / 4)), tan(coords[1] * (math.pi / 4))
    r = (coords[2] * (outer - inner) + inner) / sqrt(a * a + b * b + 1.0)
    return [r * a, r * b, r]


def square_to_disk(coords):
    """The square -1..1 onto the unit disk, edges onto the circle."""
    x, y = coords
    big = where(absolute(x) > absolute(y), absolute(x), absolute(y))
    norm = sqrt(x * x + y * y)
    ratio = where(norm > 0, big / where(norm > 0, norm, 1.0), 0.0)
    return [x * ratio, y * ratio]
